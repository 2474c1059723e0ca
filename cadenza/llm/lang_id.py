r"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of `WINDOW` (the last one may be shorter), which together hold the whole text.
In each window one recurrent network runs forward and one backward; their states label every position with a probability
for each language. A document's probabilities are the means over all its positions.

Training takes, for each language, about `TRAIN_DOCS` labelled documents (those whose hash is below a rate found from the
language's count) and `PIECES` windows of each; its loss is the cross-entropy at every position. It is a bounded sample;
predictions cover all rows and whole texts.

Defined cases: null text and text without a letter is `und` with score 0; a null id is not held out; rows with null text or lang are not trained on;
without training rows all is `und`; a language of a single document is learned as any other; repeated rows each get their
prediction; `predict` keeps all columns of its input but those named lang_pred and score, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, HIDDEN = 64, 8
TRAIN_DOCS, PIECES, STEPS, BATCH, RATE, SEED = 1500, 2, 400, 256, 0.02, 5
UNDETERMINED = "und"
#: Windows that a worker runs at a time: bounds its memory whatever the texts' length.
CHUNK = 4096
PAD = 256
_LETTER = re.compile(r"[^\W\d_]")


class BiGru:
    """Parameters: for each direction a table of input terms (one column per byte), recurrent weights and a bias, and the output layer.

    Columns are positions of a batch. Gates: z (update) and r (reset) as sigmoid, the candidate c as tanh:
    z = s(Wz x + Uz h), r = s(Wr x + Ur h), c = tanh(Wc x + r * (Uc h + d)), h' = z h + (1 - z) c.
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        f = np.float32
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(f)
            self.p[f"U{d}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(f)
            self.p[f"d{d}"] = np.zeros((hidden, 1), f)
        self.p["V"] = rng.normal(0, hidden**-0.5, (len(classes), 2 * hidden)).astype(f)
        self.p["o"] = np.zeros((len(classes), 1), f)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, hidden, batch) of direction d for bytes x (time, batch)."""
        n, (steps, batch) = self.hidden, x.shape
        w, u, bias = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"d{d}"]
        out = np.empty((steps, n, batch), np.float32)
        h = np.zeros((n, batch), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = w.take(x[t], 0).T
            b = u @ h
            gates = np.tanh(0.5 * (a[: 2 * n] + b[: 2 * n]))
            gates += 1
            gates *= 0.5
            z, r = gates[:n], gates[n:]
            inner = b[2 * n :] + bias
            c = np.tanh(a[2 * n :] + r * inner)
            if keep is not None:
                keep.append((t, h, z, r, inner, c))
            h = c + z * (h - c)
            out[t] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (classes, time, batch) at every position."""
        return self._soft(np.concatenate([self._run(x, "f"), self._run(x, "b")], 1))

    def _soft(self, states: np.ndarray) -> np.ndarray:
        y = np.einsum("kh,thb->ktb", self.p["V"], states, optimize=True) + self.p["o"][:, :, None]
        y -= y.max(0)
        np.exp(y, out=y)
        y /= y.sum(0)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over unmasked positions and its gradients, by backpropagation through time."""
        n, kept = self.hidden, {"f": [], "b": []}
        states = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], 1)
        y = self._soft(states)
        total = mask.sum()
        columns = np.arange(x.shape[1])
        loss = float(-(np.log(y[label, :, columns].T + 1e-12) * mask).sum() / total)
        y[label, :, columns] -= 1
        y *= mask / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"] = np.einsum("ktb,thb->kh", y, states, optimize=True)
        g["o"] = y.sum((1, 2))[:, None]
        back = np.einsum("kh,ktb->thb", self.p["V"], y, optimize=True)
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            dh = np.zeros((n, x.shape[1]), np.float32)
            for t, h, z, r, inner, c in reversed(kept[d]):
                dh = dh + back[t, k * n : (k + 1) * n]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * inner * r * (1 - r)
                di = dc * r
                g[f"d{d}"] += di.sum(1, keepdims=True)
                du = np.concatenate([dz, dr, di])
                g[f"U{d}"] += du @ h.T
                np.add.at(g[f"W{d}"], x[t], np.concatenate([dz, dr, dc]).T)
                dh = dh * z + u.T @ du
        return loss, g


def windows(raw: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (width, n), mask (width, n), number of the text of each window) that hold all of the texts."""
    lengths = np.array([len(r) for r in raw], np.int64)
    per = -(-lengths // width)
    x = np.full(int(per.sum()) * width, PAD, np.int16)
    starts = np.concatenate([[0], np.cumsum(per)[:-1]]) * width
    for r, s in zip(raw, starts.tolist(), strict=True):
        x[s : s + len(r)] = np.frombuffer(r, np.uint8)
    x = np.ascontiguousarray(x.reshape(-1, width).T)
    return x, (x != PAD), np.repeat(np.arange(len(raw)), per)


def fit(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> BiGru | None:
    """Learns from (text, language) by Adam over random batches; each window is used whole or cut short."""
    samples = sorted((t, k) for t, k in samples if t)
    if not samples:
        return None
    classes = sorted({k for _, k in samples})
    net, rng = BiGru(classes, seed=seed), np.random.default_rng(seed)
    x, mask, of = windows([t.encode("utf-8", "replace")[:WINDOW] for t, _ in samples])
    label = np.array([classes.index(samples[k][1]) for k in of])
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], BATCH)
        width = int(rng.choice([8, 16, 32, WINDOW]))
        _, g = net.gradients(x[:width, pick], label[pick], mask[:width, pick].astype(np.float32))
        norm = float(np.sqrt(sum((v**2).sum() for v in g.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> BiGru | None:
    """Learns from rows that are not held_out (a null id is not); about per_language documents of each language."""
    rows = documents.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull() & ~held_out(F.col(doc)))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc, text).alias("h"))
    share = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    rows = rows.where(share < F.element_at(rate, F.col("lang")))
    spot = lambda k: (F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1).cast("int")
    rows = rows.select("lang", F.explode(F.array(*[F.substring("text", spot(k), F.lit(WINDOW)) for k in range(PIECES)])).alias("piece"))
    return fit([(r["piece"], r["lang"]) for r in rows.collect()])


def _pooled(net: BiGru, texts: list[str]) -> np.ndarray:
    """Mean probabilities (texts, classes) over all positions; texts are not empty."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    x, mask, of = windows(raw)
    sums = np.zeros((len(texts), len(net.classes)))
    for at in range(0, x.shape[1], CHUNK):
        part = slice(at, at + CHUNK)
        y = (net.positions(x[:, part]) * mask[:, part]).sum(1)
        for k in range(len(net.classes)):
            sums[:, k] += np.bincount(of[part], y[k], len(texts))
    return sums / np.array([len(r) for r in raw])[:, None]


def predict(documents: DataFrame, net: BiGru | None, text: str = "text") -> DataFrame:
    """documents with lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def labels(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": np.zeros(len(s))})
            known = [k for k, t in enumerate(s) if net is not None and t and _LETTER.search(t)]
            while known:  # about a million characters at a time, or one text
                size, n = 0, 0
                while n < len(known) and (n == 0 or size + len(s.iloc[known[n]]) < 1 << 20):
                    size += len(s.iloc[known[n]])
                    n += 1
                part, known = known[:n], known[n:]
                p = _pooled(net, [s.iloc[k] for k in part])
                out.iloc[part, 0] = [net.classes[k] for k in p.argmax(1)]
                out.iloc[part, 1] = np.clip(p.max(1), 0, 1)
            yield out

    done = documents.withColumn("__lang", labels(F.coalesce(F.col(text), F.lit(""))))
    return done.select(*[c for c in documents.columns if c not in ("lang_pred", "score")], "__lang.lang_pred", "__lang.score")
