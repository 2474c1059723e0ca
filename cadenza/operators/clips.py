"""Filters and derived columns of clip rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import BUCKETS, CLIP_COLUMNS, MAX_CLIP_S, MIN_CLIP_S


def keeps(duration: Column, value: Column) -> Column:
    """A transcript that is not blank, and 0.5 to 60 seconds, both inclusive. Null is not kept."""
    return F.coalesce(value.rlike(r"(?U)\S") & duration.between(MIN_CLIP_S, MAX_CLIP_S), F.lit(False))


def streamable(duration: Column, value: Column) -> Column:
    """The looser rule of the native-clip scan: some text, also blank, and a duration above 0."""
    return F.coalesce((duration > 0) & (value != ""), F.lit(False))


def drop_long(rows: DataFrame, duration: str = "duration", top: float = MAX_CLIP_S) -> DataFrame:
    return rows.where(F.col(duration) <= top)


def kept_and_dropped(rows: DataFrame, duration: str = "duration", value: str = "text") -> DataFrame:
    kept = keeps(F.col(duration), F.col(value))
    return rows.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def derived(rows: DataFrame) -> DataFrame:
    """rows with bucket, length (whole milliseconds, cut) and audio_file."""
    return rows.withColumns({"bucket": text.bucket(F.col("duration")), "length": (F.col("duration") * 1000).cast("long"), "audio_file": text.base_name(F.col("audio_path"))})


def as_clips(rows: DataFrame) -> DataFrame:
    """rows in the fixed column order of a clip; a missing source is null."""
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit(None).cast("string"))
    return rows.select(*CLIP_COLUMNS)


def drop_empty(spans: Column, texts: Column) -> Column:
    """array<struct<start,end,text>> of the spans whose text is not empty."""
    both = F.zip_with(spans, texts, lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("text")))
    return F.filter(both, lambda x: F.coalesce(F.trim(x["text"]) != "", F.lit(False)))


def bucket_counts(rows: DataFrame, duration: str = "duration") -> DataFrame:
    """(bucket, n) of the buckets that occur, in order of length."""
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return rows.groupBy(text.bucket(F.col(duration)).alias("bucket")).agg(F.count("*").alias("n")).orderBy(order)
