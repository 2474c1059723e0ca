"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import near_dup
from cadenza.llm.components import components


def shingles(t, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < size else frozenset(zip(*[w[k:] for k in range(size)]))


def brute(rows, size=3, percent=85):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def made(seed, groups=12, size=14):
    """Groups around base texts, with edits near the threshold, chains, shared passages, and short and equal texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    passage = [word() for _ in range(80)]
    texts = [None, "", " ", "one", "One", "one two", "ONE  two", "one two three", "É a b c", "é a b c"]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 30, 120]))] + (passage if g % 3 == 0 else [])
        for k in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(base) // 30])):
                t[rng.randrange(len(t))] = word()
            if g % 4 == 0:
                base = t  # a chain: each is near the one before
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return list(enumerate(texts))


def linked(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).repartition(3)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.link(df, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert linked(spark, rows) == brute(rows)


def test_five_word_shingles_against_brute_force(spark):
    rows = made(5, groups=8)
    got = linked(spark, rows, rule=near_dup.FIVE_WORDS)
    assert got == brute(rows, 5, 80) and got != brute(rows)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    monkeypatch.setattr(near_dup, "PART", 3)
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "WIDTH", 50)
    rows = made(3, groups=6, size=25)
    assert linked(spark, rows) == brute(rows)


def test_cases(spark):
    kind = "doc_id long, text string, n_chars long"
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 1), (7, "A b  c d e f", 1), (8, None, 0), (9, "", 0)]
    d = spark.createDataFrame(rows, kind)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.link(d).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, None, True), (7, 5, False), (8, 8, True), (9, 9, True)], key=repr)
    left = near_dup.drop_duplicates(d)
    assert left.columns == d.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([5, 5, None, 8, 9], key=repr)
    assert near_dup.link(d.limit(0)).count() == 0


def test_long_text(spark):
    t = " ".join(map(str, range(60_000)))
    got = near_dup.link(spark.createDataFrame([(1, t), (2, t + " end")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    c = near_dup._coefficients(512)
    a = rng.integers(0, 1 << 63, 5000, np.uint64)
    s, t = near_dup.signature(np.sort(a[:4000]), c), near_dup.signature(np.sort(a[1000:]), c)
    assert abs((s == t).mean() - 0.6) < 0.08


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == root.keys()
    assert len({(find(x), c) for x, c in got.items()}) == len({find(x) for x in root}) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    from cadenza.llm import components as module

    rounds, written = [], module.written
    monkeypatch.setattr(module, "written", lambda df, label: rounds.append(label) or written(df, label))
    n = 1024
    got = components(spark.range(n).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == n + 1 and len({r["comp"] for r in got}) == 1
    assert rounds.count("cc-first") <= 12
