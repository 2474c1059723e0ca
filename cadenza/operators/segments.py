"""Segmentation: greedy sessions, interval merging, fixed chunks; folds over a channel's ordered array, without Python.

A channel (a recording) is the unit that is folded, so channels spread over tasks; a channel's clips stand in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_S, MAX_SEGMENT_S, MIN_SEGMENT_S = 0.3, 60.0, 5.0


def _ordered(rows: DataFrame, channel: str, *cols: Column) -> DataFrame:
    return rows.groupBy(channel).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("xs"))


def plan_segments(rows: DataFrame, channel: str = "channel", order: str = "idx", duration: str = "duration", seed: int | str = 42, gap: float = GAP_S) -> DataFrame:
    """(channel, seg_no, clips: array of order values, total): consecutive clips joined up to a target length.

    Each segment draws a target (15 % of 30 to 60 s, else 5 to 30 s) by hash of seed, channel and the segment's number. A clip
    that would pass 60 s, gap included, begins a new segment; one that reaches the target ends its own. Segments below
    5 s are dropped.
    """
    folded = _ordered(rows, channel, F.col(order).cast("bigint").alias("ix"), F.col(duration).cast("double").alias("dur"))
    key = f"concat('{seed}|', coalesce({channel}, ''), '|', cast(o as string), '{{0}}')"
    u = lambda c: f"conv(substr(md5({key.format(c)}), 1, 13), 16, 10) / 4503599627370496D"
    target = f"(CASE WHEN {u('a')} < 0.15D THEN 30D + 30D * {u('b')} ELSE 5D + 25D * {u('b')} END)"
    at = lambda o: target.replace("cast(o as string)", f"cast({o} as string)")
    close = f"CASE WHEN acc.tot >= {MIN_SEGMENT_S}D THEN concat(acc.out, array(named_struct('no', acc.o, 'clips', acc.ix, 'total', acc.tot))) ELSE acc.out END"
    full = f"size(acc.ix) > 0 AND (acc.tot >= acc.t OR acc.tot + {gap}D + x.dur > {MAX_SEGMENT_S}D)"
    fold = f"""aggregate(xs,
      named_struct('out', cast(array() as array<struct<no:int,clips:array<bigint>,total:double>>), 'ix', cast(array() as array<bigint>), 'tot', 0D, 'o', 0, 't', {at('0')}),
      (acc, x) -> CASE WHEN {full}
        THEN named_struct('out', {close}, 'ix', array(x.ix), 'tot', x.dur, 'o', acc.o + 1, 't', {at('acc.o + 1')})
        ELSE named_struct('out', acc.out, 'ix', concat(acc.ix, array(x.ix)), 'tot', acc.tot + (CASE WHEN size(acc.ix) > 0 THEN {gap}D ELSE 0D END) + x.dur, 'o', acc.o, 't', acc.t) END,
      acc -> {close})"""
    return folded.select(channel, F.explode(F.expr(fold)).alias("s")).select(channel, F.col("s.no").alias("seg_no"), F.col("s.clips").alias("clips"), F.col("s.total").alias("total"))


def join_clips(rows: DataFrame, plan: DataFrame, channel: str = "channel", order: str = "idx", value: str = "text") -> DataFrame:
    """(channel, seg_no, text): the clips' texts of each planned segment, in order, joined by a space."""
    each = plan.select(channel, "seg_no", F.explode("clips").alias("__ix"))
    each = each.join(rows.select(F.col(channel).alias("__c"), F.col(order).alias("__o"), F.col(value).alias("__t")), F.col(channel).eqNullSafe(F.col("__c")) & (F.col("__ix") == F.col("__o")))
    return each.groupBy(channel, "seg_no").agg(ordered_text("__ix", "__t").alias(value))


def ordered_text(order: str, value: str, between: str = " ") -> Column:
    """Aggregate: values in order, joined; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between)


def merge_intervals(spans: Column, max_seconds: float = 30.0, max_gap: float = 0.8, pad: float = 0.2, total: Column | None = None) -> Column:
    """Sorted array<struct<start,end>> with neighbours glued while the whole stays within max_seconds and the pause within
    max_gap; then padded on both sides and clamped to 0 and total (the last end plus pad, if not given)."""
    kind = "array<struct<start:double,end:double>>"
    span = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    none = F.lit(None).cast("double")
    closed = lambda acc: F.when(acc["open"]["start"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, x: Column) -> Column:
        last = acc["open"]
        fits = F.coalesce((x["end"] - last["start"] <= max_seconds) & (x["start"] - last["end"] <= max_gap), F.lit(False))
        longer = F.struct(acc["done"].alias("done"), span(last["start"], x["end"]).alias("open"))
        return F.when(fits, longer).otherwise(F.struct(closed(acc).alias("done"), span(x["start"], x["end"]).alias("open")))

    merged = F.aggregate(spans, F.struct(F.array().cast(kind).alias("done"), span(none, none).alias("open")), step, closed)
    if pad <= 0:
        return merged

    def padded(m: Column) -> Column:
        limit = total if total is not None else F.try_element_at(m, F.lit(-1))["end"] + pad
        return F.transform(m, lambda s: span(F.greatest(F.lit(0.0), s["start"] - pad), F.least(limit, s["end"] + pad)))

    return F.transform(F.array(merged), padded)[0]  # as a variable, so that the fold runs once


def merge_spans(rows: DataFrame, key: str, start: str, end: str, tie: str, **options) -> DataFrame:
    """merge_intervals over rows: (key, seg_no, start, end)."""
    folded = _ordered(rows, key, F.col(start).cast("double").alias("start"), F.col(tie).alias("tie"), F.col(end).cast("double").alias("end"))
    return folded.select(key, F.posexplode(merge_intervals(F.col("xs"), **options)).alias("seg_no", "s")).select(key, "seg_no", "s.start", "s.end")


def fixed_chunks(total: Column, chunk: float = 60.0) -> Column:
    """Array of [0, chunk), [chunk, 2 chunk), ... up to total; one span if it fits."""
    last = F.greatest(F.ceil(total / chunk) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: F.struct((k * chunk).cast("double").alias("start"), F.least((k + 1) * F.lit(float(chunk)), total.cast("double")).alias("end")))


def segment_spans(total: Column, speech: Column | None, max_seconds: float = 30.0, chunk: float = 60.0, **options) -> Column:
    """Spans to decode: one if the audio is short; merged speech spans if there are any; else fixed chunks."""
    whole = F.array(F.struct(F.lit(0.0).alias("start"), total.cast("double").alias("end")))
    out = F.when(total <= max_seconds, whole)
    if speech is not None:
        out = out.when(F.size(speech) > 0, merge_intervals(speech, max_seconds=max_seconds, total=total.cast("double"), **options))
    return out.otherwise(fixed_chunks(total, chunk))


def slice_samples(samples: Column, start: Column, end: Column, rate: int = 16_000) -> Column:
    """Samples of a span, cut to what there is."""
    lo = F.greatest((start * rate).cast("int"), F.lit(0))
    hi = F.least((end * rate).cast("int"), F.size(samples))
    return F.slice(samples, lo + 1, F.greatest(hi - lo, F.lit(0)))


def concat_samples(parts: Column, rate: int = 16_000, gap: float = GAP_S) -> Column:
    """Arrays of samples in one, with silence between them."""
    silence = F.array_repeat(F.lit(0.0).cast("float"), int(gap * rate))
    return F.flatten(F.transform(parts, lambda p, k: F.when(k > 0, F.concat(silence, p)).otherwise(p)))


def gap_sessions(rows: DataFrame, key: str, start: str, end: str, tie: str, max_gap: float) -> DataFrame:
    """(key, session_no, start, end, n): islands with pauses of at most max_gap between one row's end and the next one's start."""
    from pyspark.sql import Window as W

    order = W.partitionBy(key).orderBy(start, tie)
    new = F.coalesce((F.col(start) - F.lag(end).over(order) > max_gap).cast("int"), F.lit(0))
    numbered = rows.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(order))
    return numbered.groupBy(key, "session_no").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))
