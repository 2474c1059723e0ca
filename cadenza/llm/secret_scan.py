r"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Patterns, leftmost and non-overlapping per kind: `assign`, `access` and `hex` (see PATTERNS). Besides, every run of
``[A-Za-z0-9+/_=-]``, less the pattern spans in it, leaves parts of 16 or more characters, which are scored by two
first-order Markov models over characters: one of random strings, one of ordinary identifiers. A part whose mean
log-likelihood ratio is above the threshold is a `random` span. So is a piece of letters and digits that holds an `access` or
`hex` span and more, if its mean is above the threshold: such a span is a cut of a longer secret. In any other part, pieces of 16 or more characters between
``+/_=-`` whose mean is above it are, and stretches whose summed ratios pass a second threshold, so that a path or a name
beside a secret does not hide it. A stretch is widened to whole pieces
(an outer piece of which it holds less than half is left out) and has 16 or more characters; short
numbers and repeated separators, as in dates and rules, do not count for it. Both models are trained from labelled samples:
random strings from a seeded generator, identifiers made of about `TRAIN_WORDS` different words of about `TRAIN_DOCS` documents
(those whose hash is below a rate; their whole texts). The thresholds are set on a part of the samples that the models have not
seen, that of the stretches on identifiers joined to paths.

Offsets are code points, the end exclusive. Defined cases: null and empty text has no spans; repeated rows each get their
spans; without any documents the identifiers are a few built-in words; `redact` keeps all other columns;
`scan` replaces a column of the name it writes to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below_rate, written

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
PATTERNS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: re.ASCII: without it, two letters outside ASCII would count as s and k in either case.
_ASSIGN, _ACCESS = re.compile(PATTERNS["assign"], re.IGNORECASE | re.ASCII), re.compile(PATTERNS["access"], re.ASCII)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TRAIN_DOCS, TRAIN_WORDS, SAMPLES, SEED = 2000, 20_000, 20_000, 7
BUILT_IN = ("get", "set", "user", "name", "value", "index", "count", "list", "file", "path", "id", "key", "max", "min")


def _in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(chars)] = 1
    return table


_HEX, _RUN, _ALNUM = _in(b"0123456789abcdef"), _in(ALPHABET.encode()), _in(ALPHABET[:62].encode())
_PIECE, _FLAT = re.compile(rb"[A-Za-z0-9]+"), re.compile(rb"(?<![A-Za-z0-9])[0-9]{1,8}(?![A-Za-z0-9])|([+/_=-])\1+")
_CODE = np.full(256, 0, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(1, len(ALPHABET) + 1)


def runs(inside: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Byte spans of the maximal runs of ones with `least` characters or more; `inside` has 1 for each character of a class."""
    edge = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    yield from zip(start[keep].tolist(), end[keep].tolist(), strict=True)


class Model:
    """Log-likelihood ratio of random strings to identifiers, by transitions between characters; 0 stands for the ends."""

    def __init__(self, random: list[str], ordinary: list[str]):
        cut = lambda x: (x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :])
        (r, r_held), (o, o_held) = cut(random), cut(ordinary)
        self.table = (self._fit(r) - self._fit(o)).astype(np.float32)
        high, low = np.array([self.ratio(x.encode()) for x in r_held]), np.array([self.ratio(x.encode()) for x in o_held])
        # Above all ordinary samples but one in a thousand at most, with half the gap to the bulk of the random ones as margin.
        top, bulk = float(np.quantile(low, 0.999)), float(np.quantile(high, 0.05))
        self.threshold = max(top + max(bulk - top, 0) / 2, top)
        # The same for stretches, on paths of one to six identifiers.
        paths = ["/=_-"[k % 4].join(o_held[k : k + 1 + k % 6]) for k in range(len(o_held))]
        high, low = np.array([self._sums(x.encode())[1] for x in r_held]), np.array([self._sums(x.encode())[1] for x in paths])
        top, bulk = float(np.quantile(low, 0.999)), float(np.quantile(high, 0.05))
        self.least_sum = max(top + max(bulk - top, 0) / 2, top)

    @staticmethod
    def _fit(samples: list[str]) -> np.ndarray:
        n = len(ALPHABET) + 1
        counts = np.full((n, n), 0.5)
        for s in samples:
            c = _CODE[np.frombuffer(f" {s} ".encode(), np.uint8)]
            np.add.at(counts, (c[:-1], c[1:]), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    def ratio(self, run: bytes) -> float:
        """Mean per transition."""
        c = _CODE[np.frombuffer(b" " + run + b" ", np.uint8)]
        return float(self.table[c[:-1], c[1:]].mean())

    def _sums(self, run: bytes) -> tuple[np.ndarray, float]:
        """The ratio of each transition inside a run, and the largest sum of a stretch."""
        c = _CODE[np.frombuffer(run, np.uint8)]
        x = self.table[c[:-1], c[1:]].astype(np.float64)
        for m in _FLAT.finditer(run):
            at = slice(max(m.start() - 1, 0), m.end())
            x[at] = np.minimum(x[at], 0)
        p = np.concatenate([[0.0], np.cumsum(x)])
        return x, float((p - np.minimum.accumulate(p)).max())

    def stretches(self, run: bytes) -> list[tuple[int, int]]:
        """The parts of a run that look random, in order and apart: pieces by their mean, and stretches by their sum; one ends where the sum falls by the threshold from its peak."""
        pieces = [m.span() for m in _PIECE.finditer(run)]
        spans = [(s, e) for s, e in pieces if e - s >= LEAST["random"] and self.ratio(run[s:e]) > self.threshold]
        x, most = self._sums(run)
        first = 0
        for s, e in self._peaks(x) if most > self.least_sum else []:
            while first < len(pieces) and pieces[first][1] <= s:
                first += 1
            last = first
            while last < len(pieces) and pieces[last][0] < e:
                last += 1
            inside = pieces[first:last]
            most_of = [p for p in inside if 2 * (min(e, p[1]) - max(s, p[0])) >= p[1] - p[0]]
            wide = (inside[0][0], inside[-1][1]) if inside else (s, e)
            s, e = (most_of[0][0], most_of[-1][1]) if most_of else wide
            spans.append((s, e) if e - s >= LEAST["random"] else wide)
        out: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            while e < len(run) and run[e : e + 1] == b"=":  # padding
                e += 1
            if out and s <= out[-1][1]:
                s, e = out[-1][0], max(e, out.pop()[1])
            if e - s >= LEAST["random"]:
                out.append((s, e))
        return out

    def _peaks(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        start, total, peak, end = 0, 0.0, 0.0, 0
        for k, v in enumerate([*x.tolist(), -np.inf]):
            total += v
            if total > peak:
                peak, end = total, k + 2
            elif total <= 0 or total < peak - self.least_sum:
                if peak > self.least_sum:
                    yield start, end
                start, total, peak, end = k + 1, 0.0, 0.0, 0


def random_strings(n: int = SAMPLES, seed: int = SEED) -> list[str]:
    """Labelled samples of random strings: several alphabets, 16 to 64 characters."""
    rng = np.random.default_rng(seed)
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [low + high + "0123456789+/", low + high + "0123456789-_", low + high + "0123456789", high + "0123456789", low + "0123456789", "0123456789abcdef", "0123456789ABCDEF"]
    return ["".join(rng.choice(list(kinds[k % len(kinds)]), int(rng.integers(16, 65)))) for k in range(n)]


def identifiers(words: list[str], n: int = SAMPLES, seed: int = SEED) -> list[str]:
    """Labelled samples of ordinary identifiers of 16 characters or more, made of words."""
    rng = np.random.default_rng(seed + 1)
    words = sorted({w for w in words if w}) or list(BUILT_IN)
    out = []
    for k in range(n):
        s, style = "", k % 6
        while len(s) < 16:
            w = words[int(rng.integers(len(words)))]
            w = w.capitalize() if style == 0 else w.upper() if style == 1 else w
            s += ("_" if style in (1, 2) else "-" if style == 3 else "/" if style == 4 else "") * bool(s) + w
        out.append(s + str(int(rng.integers(100))) * bool(k % 10 == 0))
    return out


def train(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> Model:
    rows = documents.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(doc), F.length(text)).alias("h"), F.col(text).alias("t"))
    rows = rows.where(below_rate(F.col("h"), min(1.0, TRAIN_DOCS / max(rows.count(), 1))))
    words = rows.select(F.explode(F.array_distinct(F.split("t", "[^A-Za-z]+"))).alias("w")).where(F.length("w").between(2, 24)).distinct()
    words = written(words, "secret-words")
    words = words.where(below_rate(F.xxhash64("w"), min(1.0, TRAIN_WORDS / max(words.count(), 1))))
    return Model(random_strings(), identifiers([r["w"] for r in words.collect()]))


def find(text: str | None, model: Model | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start and kind; without a model the patterns only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    chars = np.frombuffer(raw, np.uint8)
    at = to = int
    if len(raw) != len(text):  # between bytes and code points
        first = (chars & 0xC0) != 0x80
        of_byte, of_char = np.concatenate([[0], np.cumsum(first)]), np.append(np.flatnonzero(first), len(raw))
        at, to = (lambda k: int(of_byte[k])), (lambda k: int(of_char[k]))
    low, out = raw.lower(), []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    hexes = list(runs(_HEX[chars], LEAST["hex"]))
    if model is not None:
        inside = _RUN[chars]
        whole = [(to(s), to(e), k) for s, e, k in out] + [(s, e, 2) for s, e in hexes]
        found: set[tuple[int, int]] = set()
        cuts = [s for s, _, kind in whole if kind != 0]
        if cuts:  # the pieces of letters and digits that hold them
            edge = np.flatnonzero(np.diff(_ALNUM[chars], prepend=0, append=0))
            k = np.unique(np.searchsorted(edge[::2], cuts, "right") - 1)
            found = set(zip(edge[::2][k].tolist(), edge[1::2][k].tolist(), strict=True)) - {(s, e) for s, e, _ in whole}
            found = {(s, e) for s, e in found if model.ratio(raw[s:e]) > model.threshold}
        for s, e in [(s, e) for s, e, _ in whole] + sorted(found):
            inside[s:e] = 0
        out += [(at(s), at(e), 3) for s, e in found]
        for s, e in runs(inside, LEAST["random"]):
            part = raw[s:e]
            here = [(0, e - s)] if model.ratio(part) > model.threshold else model.stretches(part)
            out += [(at(s + x), at(s + y), 3) for x, y in here]
    out += [(at(s), at(e), 2) for s, e in hexes]
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan(documents: DataFrame, model: Model, text: str = "text", to: str = "spans") -> DataFrame:
    """documents with a column `to`: array of struct<start,end,kind>, in order."""

    @F.pandas_udf("array<struct<start: long, end: long, kind: string>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in find(t, model)] for t in s], dtype=object)

    return documents.withColumn(to, spans(F.coalesce(F.col(text), F.lit(""))))


def redact(documents: DataFrame, model: Model | None = None, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """documents with each secret replaced by `mark` (overlapping spans by one); an n_chars column follows the text."""
    model = model or train(documents, text=text)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            out, upto = [], 0
            for s, e, _ in find(t, model):
                if s >= upto:
                    out += [t[upto:s], mark]
                upto = max(upto, e)
            return "".join([*out, t[upto:]]) if out else t

        for s in texts:
            yield s.map(one, na_action="ignore")

    done = documents.withColumn("__clean", clean(F.col(text)))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("__clean").eqNullSafe(F.col(text)), F.col("n_chars")).otherwise(F.length("__clean").cast(kind)))
    return done.withColumn(text, F.col("__clean")).select(*documents.columns)
