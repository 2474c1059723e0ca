r"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Each text gets its set of distinct shingles (64-bit hashes) and a signature of `COORDS` minima. Texts with equal
   sets are one class; only classes go on, so copies cost nothing further.
2. Each class is posted under its (coordinate, value) pairs, and the pairs are counted. Two signatures that agree in
   `MATCHES` places or more share a pair among the first COORDS - MATCHES + 1 of either, in the order of ascending
   counts. Pairs of a single class cannot be shared, so a class with fewer than MATCHES shared pairs is done, and the
   others are posted under this prefix only: the frequent pairs (common passages) are skipped.
3. In the posting lists, collisions are counted between each member and the list's first class, and each member's best
   such partner becomes a candidate. Candidates are confirmed on full sets; confirmed ones are joined to components.
4. Lists whose members are all in one component are skipped. In the others, all pairs between components whose signatures
   agree in MATCHES places or more are confirmed on full sets: those of lists of up to `SMALL` members as a table of
   different pairs, those of longer lists in blocks of `BLOCK` members against blocks, in two steps. First, on signatures
   alone, a task for each block pair names the members that agree with one of another component. Only those go on with
   their full sets, to a task where intersections of all pairs are one matrix product, and only links that join two
   components of the block pair leave it. So every pair is looked at, while no long list is expanded into its pairs, and
   sets go only where signatures agree. Then components once more.

A `Rule` says how many words a shingle has, which similarity links, and how many of the COORDS places must agree (MATCHES
above). A pair at the threshold is missed if its signatures agree in fewer places: the probability is 2.4e-6 for
`CONTRACT` (3 words, 0.85) and 1.2e-6 for `FIVE_WORDS` (5 words, 0.8).

Words: A-Z lower-cased, ``[^\x20\x09-\x0D]+``. Defined cases: null or empty text has an empty set, linked with nothing;
texts of fewer words than a shingle have one; a null doc_id stands for no component (component_id null, kept true) and is
never a representative; repeated rows each get a row, in the same component; no rows give no rows; other columns are
ignored by `link` and kept by `drop_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import BROADCAST_ROWS, small, written
from .components import components

COORDS, SEED = 64, 20260101
SMALL, BLOCK = 16, 4096
#: Members of a side that a task compares at a time.
PART = 1024
#: Columns of the incidence matrices at a time.
WIDTH = 4096
VOCABULARY = 1 << 18  # words whose hashes a worker remembers at a time


@dataclass(frozen=True)
class Rule:
    """Which texts are near-duplicates: words of a shingle, least similarity in percent, places of a signature that must agree."""

    shingle: int
    percent: int
    matches: int


CONTRACT, FIVE_WORDS = Rule(3, 85, 40), Rule(5, 80, 35)


class _WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, size: int = CONTRACT.shingle) -> np.ndarray:
    """Sorted distinct uint64 hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    acc = np.full(n, min(len(words), size), np.uint64)  # so that a short text is no part of a longer one
    for k in range(min(len(words), size)):
        acc = (acc ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, (coords, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (coords, 1), np.uint32)


def signature(shingles: np.ndarray, coords: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """uint32 minima of a set, one per coordinate, each under its own permutation a x + b of the numbers below 2^32."""
    a, b = coords
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = a * x[at : at + 2048]
        h += b
        np.minimum(out, h.min(1), out=out)
    return out


def set_class(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int(np.frombuffer(xxh64_intdigest(shingles.tobytes()).to_bytes(8, "little"), np.int64)[0])


FEATURES = "doc_id long, fingerprint long, n_shingles long, cls long, sig array<int>"


def _features(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, coords = _WordHashes(), _coefficients(COORDS)
        for batch in batches:
            size, cls, sig = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), hashes, rule.shingle)
                size.append(len(s))
                cls.append(set_class(s) if len(s) else None)
                sig.append(signature(s, coords) if len(s) else np.zeros(COORDS, np.uint32))
            values = np.concatenate(sig).view(np.int32) if sig else np.empty(0, np.int32)
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, COORDS * (len(sig) + 1), COORDS), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), sigs], ["doc_id", "fingerprint", "n_shingles", "cls", "sig"])

    return run


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # sets are longer than texts: small batches out
                part = batch.slice(k, 256)
                sets = [shingle_set(t.as_py(), hashes, rule.shingle).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return run


def _similar(rule: Rule):
    @F.pandas_udf(T.BooleanType())
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            if 100 * len(a) < rule.percent * len(b):
                out.append(False)
                continue
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            out.append(100 * both >= rule.percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return similar


def _intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one with all of two."""
    at = lambda sets: np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    x, y = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(x, y)
    out = np.zeros((len(one), len(two)), np.float32)
    side = []
    for values, rows in ((x, at(one)), (y, at(two))):
        k = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        keep = common[k] == values if len(common) else np.zeros(len(values), bool)
        k, rows = k[keep], rows[keep]
        order = np.argsort(k, kind="stable")
        side.append((k[order], rows[order]))
    for lo in range(0, len(common), WIDTH):
        parts = []
        for (k, rows), n in zip(side, out.shape, strict=True):
            s, e = np.searchsorted(k, [lo, lo + WIDTH])
            m = np.zeros((n, min(WIDTH, len(common) - lo)), np.float32)
            m[rows[s:e], k[s:e] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _agree(one: pd.DataFrame, two: pd.DataFrame, rule: Rule) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Part by part, which members of one and two are of different components and have signatures that agree in enough places."""
    sig = lambda g: np.stack(g.sig.to_numpy()).astype(np.int32)
    s, t = sig(one), sig(two)
    x, y = one.comp.to_numpy(), two.comp.to_numpy()
    for i in range(0, len(s), PART):
        for j in range(0, len(t), PART):
            p, q = slice(i, i + PART), slice(j, j + PART)
            same = np.zeros((len(s[p]), len(t[q])), np.uint8)
            for k in range(COORDS):
                same += s[p, k, None] == t[None, q, k]
            yield p, q, (same >= rule.matches) & (x[p, None] != y[None, q])


def _likely(one: pd.DataFrame, two: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """The members that agree with one of the other side (that is one, if two is one)."""
    left, right = np.zeros(len(one), bool), np.zeros(len(two), bool)
    for p, q, ok in _agree(one, two, rule):
        left[p] |= ok.any(1)
        right[q] |= ok.any(0)
    return one[left] if two is one else pd.concat([one[left], two[right]])


def _links(one: pd.DataFrame, two: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Links (a, b) between members of different components, as many as join what they can join."""
    out: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = ([np.frombuffer(x, np.uint64) for x in g.shingles] for g in (one, two))
    left, right = one[["cls", "comp"]].to_numpy(), two[["cls", "comp"]].to_numpy()
    for p, q, ok in _agree(one, two, rule):
        if not ok.any():
            continue
        both = _intersections(a[p], b[q])
        union = np.array([len(x) for x in a[p]])[:, None] + np.array([len(x) for x in b[q]])[None, :] - both
        for i, j in zip(*np.nonzero(ok & (100 * both >= rule.percent * union)), strict=True):
            x, y = find(left[p][i, 1]), find(right[q][j, 1])
            if x != y:
                root[x] = y
                out.append((left[p][i, 0], right[q][j, 0]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _by_block_pair(f, columns: list[str], rule: Rule):
    """A function for mapInPandas over rows in order of token, i, j: f of the members of each block pair on side 0 and side 1
    (the same, where i = j)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None

        def flush() -> Iterator[pd.DataFrame]:
            g = pd.concat(held)
            one, two = g[g.side == 0], g[g.side == 1]
            if len(one) and (key[1] == key[2] or len(two)):
                yield f(one, one if key[1] == key[2] else two, rule)[columns]

        for batch in batches:
            for k, g in batch.groupby(["token", "i", "j"], sort=False):
                if k != key and held:
                    yield from flush()
                    held = []
                key = k
                held.append(g)
        if held:
            yield from flush()

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return written(both.select("a", "b", _similar(rule)("x", "y").alias("linked")).where("linked").select("a", "b"), "near-pairs")


def link(documents: DataFrame, doc: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """One row per document row: doc_id, fingerprint (of the text), n_shingles, component_id, kept."""
    texts = documents.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("fingerprint"), F.col(text).alias("text"))
    docs = written(texts.mapInArrow(_features(rule), FEATURES), "near-features")
    named = docs.where("cls is not null and doc_id is not null")
    classes = named.groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig"))
    classes = written(classes, "near-classes")

    # Postings: token = coordinate and value.
    tokens = classes.select("cls", F.posexplode("sig").alias("pos", "value")).select("cls", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(counts, "token").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))  # at most COORDS
    prefix = shared.where(F.size("shared") >= rule.matches).select("cls", F.explode(F.slice("shared", 1, F.size("shared") - rule.matches + 1)).alias("s"))
    lists = written(prefix.select("cls", F.col("s.token").alias("token")), "near-lists")
    alive = lists.select("cls").distinct()

    # Full sets, of classes that are in some list: of one text per class.
    wanted = classes.join(alive, "cls", "left_semi").select("cls", F.col("first_doc").alias("first_doc_"))
    wanted = small(written(wanted, "near-wanted"))
    reps = docs.where("cls is not null").select("doc_id", "fingerprint", "cls")
    reps = reps.join(wanted.withColumnRenamed("cls", "cls_"), (F.col("cls") == F.col("cls_")) & (F.col("doc_id") == F.col("first_doc_"))).groupBy("cls").agg(F.first("doc_id").alias("d"), F.first("fingerprint").alias("p"))
    reps = small(written(reps, "near-reps"))
    sets = texts.join(reps, (F.col("doc_id") == F.col("d")) & (F.col("fingerprint") == F.col("p"))).select("cls", "text").mapInArrow(_sets(rule), "cls long, shingles binary")
    sets = sets.groupBy("cls").agg(F.first("shingles").alias("shingles"))  # repeated rows of the representative
    sets = written(sets, "near-sets")

    # Round 0: each member with the first class of each of its lists; collisions are counted, the best stays.
    first = lists.groupBy("token").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hits = lists.join(first, "token").where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("n"))
    pairs = hits.groupBy("cls").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
    links = _confirmed(pairs, sets, rule)
    comps = components(links)
    more = _across(lists, classes, comps, sets, rule)
    if more is not None:
        comps = components(links.union(more))

    comp = named.groupBy("cls").agg(F.min("doc_id").alias("first_doc")).join(comps.withColumnRenamed("node", "cls"), "cls")
    roots = comp.groupBy("comp").agg(F.min("first_doc").alias("root"))
    comp = written(comps.join(roots, "comp").select(F.col("node").alias("cls"), "root"), "near-roots")
    whole = classes.select("cls", "first_doc").join(comp, "cls", "left").select("cls", F.coalesce("root", "first_doc").alias("root"))
    out = docs.select("doc_id", "fingerprint", "n_shingles", "cls").join(whole, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", "fingerprint", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _across(lists: DataFrame, classes: DataFrame, comps: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame | None:
    """Links (a, b) between components, from lists that hold more than one; None if no list does."""
    rows = lists.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", F.coalesce("comp", "cls").alias("comp"))
    rows = written(rows, "near-members")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y").select("token", "n")
    rows = written(rows.join(mixed, "token"), "near-mixed")
    if rows.isEmpty():
        return None
    sigs = classes.select("cls", "sig")

    # Short lists: their pairs, at most (SMALL - 1) / 2 for each row, each compared once.
    members = rows.where(F.col("n") <= SMALL).groupBy("token").agg(F.collect_list(F.struct("cls", "comp")).alias("m"))
    later = lambda i: F.slice("m", i + 2, F.lit(SMALL))
    cross = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(later(i), lambda y: y["comp"] != x["comp"]), lambda y: F.struct(F.least(x["cls"], y["cls"]).alias("a"), F.greatest(x["cls"], y["cls"]).alias("b")))))
    pairs = members.select(F.explode(cross).alias("p")).select("p.a", "p.b").distinct()
    pairs = pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("s")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("t")), "b")
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    links = _confirmed(pairs.where(same >= rule.matches).select("a", "b"), sets, rule)

    # Long lists, in block pairs i <= j: a member of block k is on side 0 where i = k, and on side 1 where j = k > i.
    rows = rows.where(F.col("n") > SMALL)
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.select("token", "cls", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    rows = rows.select("token", "cls", "comp", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.when(F.col("block") <= F.col("o"), 0).otherwise(1).alias("side"))
    dealt = lambda df: df.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    names = ["token", "i", "j", "side", "cls", "comp"]
    likely = written(dealt(rows.join(sigs, "cls")).mapInPandas(_by_block_pair(_likely, names, rule), "token long, i int, j int, side int, cls long, comp long"), "near-likely")
    if likely.isEmpty():
        return links
    found = dealt(likely.join(sigs, "cls").join(sets, "cls")).mapInPandas(_by_block_pair(_links, ["a", "b"], rule), "a long, b long")
    return links.union(written(found, "near-across"))


def drop_duplicates(documents: DataFrame, doc: str = "doc_id", text: str = "text", rule: Rule = FIVE_WORDS) -> DataFrame:
    """documents without those that are not kept; all columns stay."""
    gone = link(documents, doc, text, rule).where("not kept").select(F.col("doc_id").alias("__doc"), F.col("fingerprint").alias("__print")).distinct()
    gone = written(gone, "near-gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    return documents.join(gone, (documents[doc] == F.col("__doc")) & F.xxhash64(documents[text]).eqNullSafe(F.col("__print")), "left_anti")
