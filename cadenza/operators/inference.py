"""Model inference over rows: batches by length, a model loaded once per worker, greedy decoding, padding, punctuation.

A Transcriber is any picklable factory that returns a function from a list of sample arrays to a list of texts; no model
weights come with this package.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import length_batches

Transcriber = Callable[[], Callable[[list[np.ndarray]], list[str]]]


def transcribe(rows: DataFrame, factory: Transcriber, index: str = "idx", samples: str = "samples", size: int = 8, to: str = "hyp", seconds: str | None = None) -> DataFrame:
    """rows with hypotheses. Batches are by length, so that little is padded; results keep their row, whatever the order. With
    `seconds`, that column has the row's share (by samples) of the time that its batch took in the worker.

    Batches are planned on index and length alone; samples are shuffled once, to their batch. The index is unique and not null."""
    plan = length_batches(rows.select(index, F.size(samples).alias("__len")), "__len", index, size).drop("__len")
    batched = rows.join(plan, index)
    batched = batched.repartition("batch_id").sortWithinPartitions("batch_id", index)
    kept = [f for f in rows.schema.fields if f.name != samples]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{to}` string"] + [f"`{seconds}` double"] * bool(seconds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            for _, g in b.groupby("batch_id", sort=False):
                began = time.perf_counter()
                texts = model([np.asarray(x, np.float32) for x in g[samples]])
                out = g[[f.name for f in kept]].assign(**{to: list(texts)})
                if seconds:
                    took, sizes = time.perf_counter() - began, g[samples].map(len).to_numpy(float)
                    out[seconds] = took * sizes / sizes.sum() if sizes.sum() else took / len(g)
                yield out

    return batched.mapInPandas(run, schema)


def transcribe_spans(rows: DataFrame, factory: Transcriber, key: str = "file", samples: str = "samples", spans: str = "spans", size: int = 4, rate: int = 16_000) -> DataFrame:
    """(key, text, segments, elapsed_seconds): each span of each row decoded, empty ones dropped, the rest joined in order;
    elapsed_seconds is the decoding time of all its spans. Keys are unique."""
    from .segments import slice_samples

    each = rows.select(F.col(key).alias("key"), samples, F.posexplode(spans).alias("no", "s"))
    each = each.select("key", "no", "s", slice_samples(F.col(samples), F.col("s.start"), F.col("s.end"), rate).alias("samples"))
    each = each.withColumn("idx", F.struct("key", "no"))
    said = transcribe(each, factory, "idx", "samples", size, "text", "seconds")
    segment = F.struct("no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "text")
    full = F.when(F.trim("text") != "", segment)  # collect_list leaves nulls out
    out = said.groupBy("key").agg(F.array_sort(F.collect_list(full)).alias("segments"), F.sum("seconds").alias("elapsed_seconds"))
    out = out.select("key", "elapsed_seconds", F.array_join(F.transform("segments", lambda x: x["text"]), " ").alias("text"), F.transform("segments", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("segments"))
    none = rows.select(F.col(key).alias("key")).join(out, "key", "left")
    return none.select(F.col("key").alias(key), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("segments", F.array().cast("array<struct<start:double,end:double,text:string>>")).alias("segments"), F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"))


def greedy_tokens(logits: Column, blank: int = 0) -> Column:
    """Token ids of frames of logits: the first maximum of each frame, blanks dropped, one symbol per frame at most."""
    best = F.transform(logits, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
    return F.filter(best, lambda t: t != blank)


def greedy_search(frames: np.ndarray, predict: Callable, join: Callable, blank: int = 0, context: int = 2) -> list[int]:
    """Transducer greedy search over one utterance's encoder frames: `predict` takes the last `context` symbols to a decoder
    state, and runs only after a symbol; `join` takes a frame and that state to logits."""
    symbols = [blank] * context
    state = predict(symbols[-context:])
    for frame in frames:
        best = int(np.argmax(join(frame, state)))
        if best != blank:
            symbols.append(best)
            state = predict(symbols[-context:])
    return symbols[context:]


def punctuated(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], value: str = "text") -> DataFrame:
    """rows with the text restored by a model from its lower case; blank texts pass as they are."""

    @F.pandas_udf("string")
    def restore(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            out = s.copy()
            full = s.map(lambda t: bool(t and t.strip()))
            if full.any():
                out[full] = model([t.lower() for t in s[full]])
            yield out

    return rows.withColumn(value, restore(value))


def pad(col: Column, longest: Column, fill: Column) -> Column:
    return F.concat(col, F.array_repeat(fill, (longest - F.size(col)).cast("int")))


def collate(rows: DataFrame, prompt: str = "prompt", target: str = "target", batch: str = "batch_id", pad_id: int = 0, eos_id: int = 1, ignore: int = -100) -> DataFrame:
    """rows with input_ids, labels and attention_mask, padded to the longest of their batch. Labels cover the target and the end
    mark only."""
    from pyspark.sql import Window as W

    ids = F.concat(prompt, target, F.array(F.lit(eos_id)))
    rows = rows.withColumns({"input_ids": ids, "labels": F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), F.col(target), F.array(F.lit(eos_id)))})
    rows = rows.withColumn("__most", F.max(F.size("input_ids")).over(W.partitionBy(batch)))
    mask = pad(F.transform("input_ids", lambda _: F.lit(1)), F.col("__most"), F.lit(0))
    return rows.withColumn("attention_mask", mask).withColumns({"input_ids": pad(F.col("input_ids"), F.col("__most"), F.lit(pad_id)), "labels": pad(F.col("labels"), F.col("__most"), F.lit(ignore))}).drop("__most")


def merge_low_rank(weights: DataFrame, a: DataFrame, b: DataFrame, alpha: float, rank: int) -> DataFrame:
    """(i, j, w) of W + (B A) alpha / rank, for sparse W (i, j, w), B (i, k, v) and A (k, j, v)."""
    product = b.select("i", "k", F.col("v").alias("x")).join(a.select("k", "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) * (alpha / rank)).alias("w"))
    return weights.select("i", "j", "w").unionByName(product).groupBy("i", "j").agg(F.sum("w").alias("w"))
