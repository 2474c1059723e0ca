"""Chat formatting, decontamination and mixing, against plain Python and DuckDB."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat_format, decontam, mixing, queries

TABLES = ("documents", "benchmark", "conversations", "pages", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=key) == sorted(want, key=key)


HOSTILE = ["", "a", "</turn>\n", "<turn user>\nhi</turn>\n", "<\\turn", "<\\\\/turn>", "<<turn", "é</turn", "$1 \\1", "\\### Assistant: </turn> ok", "x\n\ny", "<", "\\", "&lt;"]


def test_chat_round_trip(spark):
    rows, want = [], {}
    for k, (a, b) in enumerate(itertools.product(HOSTILE, HOSTILE)):
        turns = [("system", a), ("user", b), ("assistant", a + b), ("assistant", b)] + ([("us<er>&amp;", a)] if k % 2 else [])
        want[k] = turns
        rows += [(k, n, r, t, "extra") for n, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.prefix_target_examples(df)).collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[k]["n_targets"], got[k]["n_examples"]) == (2, 2 + k % 2)


def test_chat_examples_hold_only_what_comes_before(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")]
    got = chat_format.prefix_target_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example_no").collect()
    assert [r["formatted"].count("<turn ") for r in got] == [2, 4]
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in got] == ["a1", "a2"]


def test_chat_nulls_ties_and_no_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "assistant", None), (None, None, None, "x"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.prefix_target_examples(spark.createDataFrame(rows, kind))).collect()}
    assert (got[None]["n_turns"], got[None]["loss_chars"], got[None]["n_targets"]) == (2, 0, 1)
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nx\nassistant\n\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert chat_format.digest(chat_format.prefix_target_examples(spark.createDataFrame([], kind))).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1) if w else []:
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "é", "É", "x1", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "-", "\n"]) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (12, text(3)), (5, "the"), (None, text(11)), (7, None), (8, " ,;"), (9, "")]
    docs = [(k, text(rng.randrange(60))) for k in range(30)] + [(100, items[0][1].upper().replace("É", "É")), (101, f"x {items[1][1]} y {items[1][1]}"), (102, None), (103, ""), (101, f"x {items[1][1]} y {items[1][1]}"), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontam.scan(d, b).collect()), key=repr)
    assert got == brute_hits(docs, items)
    assert [r["n_hit"] for r in decontam.scan(d, b.limit(0)).collect()] == [0] * len(docs)
    assert decontam.scan(d.limit(0), b).count() == 0
    clean = {(r[0], r[1]) for r in brute_hits(docs, items) if r[2] == 0}
    left = decontam.remove(d, b)
    assert left.columns == d.columns
    assert {(r["doc_id"], len(words(r["text"]))) for r in left.collect()} == clean


def test_cut_spans(spark):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    t = "Start, here; One two THREE-four five six seven eight nine ten eleven. The end!"
    d = spark.createDataFrame([(1, t, 78), (2, "clean text", 10), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontam.remove(d, b, mode="spans").collect()}
    assert got == {1: ("Start, here; . The end!", 23), 2: ("clean text", 10), 3: (None, 0)}


def test_spans_merge(spark):
    span = lambda *x: [{"start": a, "end": b} for a, b in x]
    rows = [(span((0, 10), (1, 11), (11, 13), (20, 22), (21, 25), (26, 27)),), (span(),), (span((3, 5)),)]
    got = spark.createDataFrame(rows, "h array<struct<start:int,end:int>>").select(decontam.merged(F.col("h")).alias("m")).collect()
    assert [[tuple(x) for x in r["m"]] for r in got] == [[(0, 13), (20, 25), (26, 27)], [], [(3, 5)]]


def test_decontaminate_long_text(spark):
    """A text of many chunks, hit across their borders, by items of two lengths."""
    w = [f"w{k}" for k in range(50_000)]
    items = [(k, " ".join(w[k : k + 12])) for k in (0, 25, 31, 32, 49_980)] + [(9, "w77 w78")]
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:3]))], "doc_id long, text string").withColumn("cw", F.lit("clash"))
    got = {r["doc_id"]: r for r in decontam.scan(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1]["n_hit"] == 12 + len({*range(25, 37), *range(31, 44)}) + 12 + 2 and got[1]["items"] == sorted(map(str, (0, 25, 31, 32, 49_980, 9)))
    assert got[2]["n_hit"] == 0


def test_shuffled_set_finds_the_same(spark, monkeypatch, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda: sorted((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontam.scan(d, b).collect())
    one = rows()
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert rows() == one and any(r[1] for r in one)


def mixed(spark, rows, **options):
    return mixing.takes(spark.createDataFrame(rows, "doc_id long, text string, source string"), **options)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.choice([1, 3, 10, 50, 200]), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(800)]
    got = mixed(spark, rows).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        t = by.setdefault(r["source"], [r["target"], r["source_size"], 0])
        t[2] += r["taken"]
    assert abs(sum(t[0] for t in by.values()) - total) < 1e-6 * total
    assert all(-1e-6 <= t[0] - t[2] <= max(2, 0.005 * t[0]) for t in by.values())
    weights = {"a": 5, "b": 2, "c": 1, None: 5}
    free = {s: t[0] / weights[s] for s, t in by.items() if t[0] < 3 * t[1]}
    assert len({round(x, 6) for x in free.values()}) == 1
    again = mixed(spark, rows[::-1]).repartition(7).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_cases(spark):
    assert mixed(spark, []).count() == 0
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", None), (3, "x y", None), (None, "z", "c")]
    got = {(r["doc_id"], r["source"]): r for r in mixed(spark, rows).collect()}
    assert got[(1, "a")]["taken"] == got[(2, "b")]["taken"] == 0 and got[(1, "a")]["target"] == 0
    assert mixed(spark, rows).count() == 5
    d = spark.createDataFrame([(k, "w " * (k % 7), "ab"[k % 2], f"r{k}", "q") for k in range(200)], "doc_id long, text string, source string, rank string, size string")
    taken = {r["doc_id"]: r["copies"] for r in mixing.takes(d).collect()}
    out = mixing.mix(d)
    assert out.columns == [*d.columns, "copy"]
    copies = {}
    for r in out.collect():
        assert r["rank"] == f"r{r['doc_id']}"
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {k: n for k, n in taken.items() if n}


def brute_odds(sizes, rest):
    """g with sum of min(1, g * n) * n over the sizes up to rest = rest, by halving; None if all fit."""
    sizes = [n for n in sizes if 0 < n <= rest]
    if sum(sizes) <= rest:
        return None
    lo, hi = 0.0, 1.0
    for _ in range(200):
        g = (lo + hi) / 2
        lo, hi = (g, hi) if sum(min(1, g * n) * n for n in sizes) < rest else (lo, g)
    return hi


def brute_takes(rows, target, seed="mix"):
    """doc_id to copies of rows (doc_id, text, source), given each source's target."""
    units = {}
    for k, t, s in rows:
        key = hashlib.md5(f"{seed}|{k}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        u = units.setdefault((s, key), [k, 0, len(t.split()), key])
        u[1] += u[2]
    out = {}
    for s in {q for q, _ in units}:
        mine = [u for (q, _), u in units.items() if q == s]
        size = sum(u[1] for u in mine)
        copies = int(target[s] // size)
        gap = rest = target[s] - copies * size
        g = brute_odds([u[2] for u in mine for _ in range(u[1] // u[2])], rest)

        def rank(u):
            x, p = (int(u[3][:13], 16) + 0.5) / 2**52, 1.0 if g is None else g * u[2]
            return 0.0 if p >= 1 else x / (1 - x) / (p / (1 - p))

        room, done, took = float("inf"), False, set()
        for u in sorted((u for u in mine if u[2] <= rest), key=lambda u: (rank(u), u[3])):
            if u[1] <= gap and not done:
                gap, took = gap - u[1], took | {u[3]}
            elif u[1] <= room:
                room, done = gap, done or gap <= mixing.NEAR * rest
        out |= {u[0]: copies + (u[3] in took) for u in mine}
    return out


def test_inclusion_follows_the_stated_probabilities(spark):
    """Many sources of the same sizes stand for many draws: how often a document of a size is in the rest, against p."""
    sizes = [1, 2, 5, 10, 20, 20, 30, 40, 80, 150] * 20
    sources = 300
    lists = F.array(*map(F.lit, sizes))
    d = spark.range(sources * len(sizes)).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.get(lists, (F.col("id") % len(sizes)).cast("int"))).alias("text"), F.format_string("s%03d", F.floor(F.col("id") / len(sizes))).alias("source"))
    got = mixing.takes(d).groupBy("size", "source_size", "target", "copies").agg(F.count("*").alias("n")).collect()
    seen = {}
    for r in got:
        whole = int(r["target"] // r["source_size"])
        n = seen.setdefault((r["target"], r["size"]), [0, 0])
        n[0] += r["n"]
        n[1] += r["n"] * (r["copies"] - whole)
    assert len({t for t, _ in seen}) == 3
    for (target, size), (n, hit) in seen.items():
        g = brute_odds(sizes, target % sum(sizes))
        p = min(1.0, g * size)
        assert abs(hit / n - p) < 0.02 + 4 * (p * (1 - p) / n) ** 0.5, (target, size, hit / n, p)


def test_mix_goes_on_after_units_that_do_not_fit(spark):
    rng = random.Random(11)
    text = lambda k, n: f"d{k} " + "w " * (n - 1)
    # a: one document longer than the rest; b: documents of about half the rest among small ones; c: equal rows that fit one by one only.
    rows = [(k, text(k, rng.randrange(5, 60)), rng.choice("abc")) for k in range(1500)]
    rows += [(2000, text(2000, 80_000), "a"), *[(3000 + k, text(3000 + k, 3000 + 211 * k), "b") for k in range(6)], *[(4000, text(4000, 900), "c")] * 20]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.takes(d).collect()
    want = brute_takes(rows, {r["source"]: r["target"] for r in got})
    assert {r["doc_id"]: r["copies"] for r in got} == want
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        gap = mine[0]["target"] - sum(r["taken"] for r in mine)
        once = min(r["copies"] for r in mine)
        rest = mine[0]["target"] - once * sum(r["size"] for r in mine)
        assert 0 <= gap <= mixing.NEAR * rest, (s, gap)
    copies = {}
    for r in mixing.mix(d).select("doc_id", "copy").collect():
        copies[r[0]] = copies.get(r[0], 0) + 1
    assert copies == {k: n * (20 if k == 4000 else 1) for k, n in want.items() if n}
