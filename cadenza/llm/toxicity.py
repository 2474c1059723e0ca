r"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text, each counted once: words, pairs of neighbours, and pairs with one word between them, hashed to `SPACE`
coordinates; all three of words as they are (lower case, runs of letters), and of their stems (the first `STEM` letters),
so that a form never seen in training still meets its kin. FTRL-proximal has a rate of its own for each coordinate, and its
L1 term leaves most weights at zero, so what goes to the executors is the few non-zero ones.

Training takes about `TRAIN_ROWS` labelled rows of each label (those whose id's hash is below a rate), and their whole texts.
Features of fewer than `LEAST_TEXTS` of them are left out on the executors, before anything goes to the driver. Scores are
for whole texts of all rows. Defined cases: null and empty text has no feature
and gets the score of the bias; rows with a null id or label are not trained on, and of several labels of an id, 1 counts; without labels all scores are 0; repeated
rows each get their score; `score` keeps all columns of its input but one of the name it writes to, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import below_rate, written

SPACE_BITS = 20
SPACE = 1 << SPACE_BITS
TRAIN_ROWS, STEM = (2_500, 3_500), 5  # rows with label 1, with label 0
ALPHA, BETA, L1, L2, EPOCHS, SEED = 4.0, 1.0, 8.0, 0.0, 6, 11
#: Features of fewer training texts are left out; every fifth training row sets the bias instead of weights.
LEAST_TEXTS, CALIBRATE = 3, 5
VOCABULARY = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


class _WordHashes(dict):
    """word -> hashes of the word and of its stem, remembered."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = h = tuple(xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in (word, "~" + word[:STEM]))
        return h


def features(text: str | None, hashes: dict) -> np.ndarray:
    """Coordinates of all features, repeats included."""
    words = _WORD.findall(text.lower()) if text else []
    both = np.array([hashes[w] for w in words], np.uint64).reshape(-1, 2)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SPACE_BITS)).astype(np.int32)
    pair = lambda h, k: (h[:-k] * np.uint64(0x100000001B3) + np.uint64(k)) ^ (h[k:] << np.uint64(17))
    return np.concatenate([mix(x) for h in (both[:, 0], both[:, 1]) for x in (h, pair(h, 1), pair(h, 2))])


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss on binary features; the last coordinate is the bias, without L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.z, self.n, self.l1 = np.zeros(SPACE + 1), np.zeros(SPACE + 1), np.full(SPACE + 1, float(l1))
        self.l1[SPACE] = 0

    def weights(self, at) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """Non-zero weights as sorted coordinates and values: compact to send."""

    def __init__(self, at: np.ndarray, value: np.ndarray, bias: float):
        self.at, self.value, self.bias = at, value, bias

    def dense(self) -> np.ndarray:
        w = np.zeros(SPACE, np.float32)
        w[self.at] = self.value
        return w

    def score(self, text: str | None, dense: np.ndarray, hashes: dict) -> float:
        f = features(text, hashes)
        f = np.unique(f[dense[f] != 0])
        return float(_sigmoid(self.bias + float(dense[f].sum())))


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    """Learns from rows that are not held_out; labels has the id and the label."""
    known = labels.select(F.col(doc).alias("__id"), F.col(label).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))  # of several labels of an id, 1 counts
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().where("__y in (0, 1)").collect()}
    rate = lambda y, n: (F.col("__y") == y) & below_rate(F.xxhash64("__id"), min(1.0, n / max(counts.get(y, 0), 1)))
    known = F.broadcast(known.where(rate(1, rows[0]) | rate(0, rows[1])))  # about `rows` ids, whatever the size
    texts = documents.select(F.col(doc).alias("__id"), F.col(text).alias("__t")).join(known, "__id").select("__id", "__y", "__t")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            yield pd.DataFrame({"id": b["__id"], "y": b["__y"], "f": [np.unique(features(t, hashes)) for t in b["__t"]]})

    sets = written(texts.mapInPandas(found, "id long, y int, f array<int>"), "toxic-features")
    often = sets.select(F.explode("f").alias("f")).groupBy("f").count().where(F.col("count") >= LEAST_TEXTS)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("f") % 32)).alias("bits")
    often = often.groupBy((F.col("f") / 32).cast("int").alias("at")).agg(bits).collect()  # SPACE / 32 rows at most
    mask = np.zeros(SPACE // 32, "<u4")
    for r in often:
        mask[r["at"]] = r["bits"]

    def pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = np.unpackbits(mask.view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            yield pd.DataFrame({"id": b.id, "y": b.y, "f": [x[keep[x]].astype("<i4").tobytes() for x in b.f]})

    data = sets.mapInPandas(pruned, "id long, y int, f binary").toPandas().sort_values(["id", "f"], ignore_index=True)
    sets, y = [np.frombuffer(f, "<i4") for f in data.f], data.y.to_numpy()
    del data
    return fit(sets, y)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: distinct coordinates of each text."""
    if not len(rows):
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), -35.0)
    learner, rng = Ftrl(), np.random.default_rng(SEED)
    texts = np.zeros(SPACE, np.int32)
    for f in rows:
        texts[f] += 1
    rows = [np.append(f[texts[f] >= LEAST_TEXTS], np.int32(SPACE)) for f in rows]
    own = np.array([k for k in range(len(rows)) if k % CALIBRATE or len(rows) < 10 * CALIBRATE])
    for _ in range(EPOCHS):
        for k in rng.permutation(own):
            learner.learn(rows[k], labels[k])
    w = learner.weights(slice(None))
    # The bias: rows that were not learnt from show how high texts with label 0 come; that height is lifted to 0.5 at most.
    rest = [float(w[rows[k]].sum()) for k in range(0, len(rows), CALIBRATE) if labels[k] == 0 and len(own) < len(rows)]
    lift = float(np.clip(-1 - np.quantile(rest, 0.998), 0, 1.5)) if rest else 0.0
    at = np.flatnonzero(w[:SPACE])
    return Model(at.astype(np.int32), w[at].astype(np.float32), float(w[SPACE]) + lift)


def score(documents: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """documents with a column `to`, from 0 to 1."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense, hashes = model.dense(), _WordHashes()
        for s in texts:
            yield pd.Series([model.score(t, dense, hashes) for t in s], dtype="float64")

    return documents.withColumn(to, scores(F.coalesce(F.col(text), F.lit(""))))
