"""Summaries of corpora, and transcripts rendered as text, subtitles or JSON."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SPLITS


def by_source(rows: DataFrame, source: str = "source") -> DataFrame:
    """(source, n, hours), by source; hours rounded to 3 places. No rows give an empty table."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.round(F.sum("duration") / 3600, 3).alias("hours")).orderBy(source)


def value_counts(rows: DataFrame, col: str) -> DataFrame:
    """(col, n) by falling n; nulls are left out."""
    return rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def split_table(rows: DataFrame, corpus: str = "source") -> DataFrame:
    """A row per corpus; n, hours and channels for each split in columns."""
    return rows.groupBy(corpus).pivot("split", list(SPLITS)).agg(F.count("split").alias("n"), F.round(F.sum("duration") / 3600, 2).alias("hours"), F.count_distinct("channel").alias("channels"))


def crosstab(rows: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of row by col with totals: a row All and a column All."""
    cube = rows.cube(row, col).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = cube.select(F.when(F.col("g") >= 2, "All").otherwise(F.col(row)).alias(row), F.when(F.col("g") % 2 == 1, "All").otherwise(F.col(col)).alias(col), "n")
    return named.groupBy(row).pivot(col, [*values, "All"]).agg(F.coalesce(F.sum("n"), F.lit(0))).na.fill(0)


def epoch_time(n: int, examples_per_second: float) -> float:
    """Hours that an epoch takes."""
    return n / examples_per_second / 3600


def segment_line(s: Column) -> Column:
    return F.format_string("[%s -> %s] %s", text.clock(s["start"]), text.clock(s["end"]), s["text"])


def as_segments(segments: Column) -> Column:
    return F.array_join(F.transform(segments, segment_line), "\n")


def as_srt(segments: Column) -> Column:
    block = lambda s, k: F.format_string("%d\n%s --> %s\n%s\n", (k + 1).cast("int"), text.clock(s["start"], ","), text.clock(s["end"], ","), s["text"])
    return F.array_join(F.transform(segments, block), "\n")


def as_json(file: Column, result: Column) -> Column:
    """A result struct (schema.RESULT) as one JSON object; seconds to 3 places, the real-time factor to 4."""
    r3 = lambda c: F.round(c, 3)
    segments = F.transform(result["segments"], lambda s: F.struct(r3(s["start"]).alias("start"), r3(s["end"]).alias("end"), s["text"].alias("text")))
    return F.to_json(F.struct(
        file.alias("file"), result["text"].alias("text"), r3(result["audio_seconds"]).alias("audio_seconds"), r3(result["elapsed_seconds"]).alias("elapsed_seconds"),
        F.round(real_time_factor(result), 4).alias("rtf"), segments.alias("segments")))


def real_time_factor(result: Column) -> Column:
    return result["elapsed_seconds"] / F.greatest(result["audio_seconds"], F.lit(1e-9))


def rendered(rows: DataFrame, form: str = "text", file: str = "file", result: str = "result") -> DataFrame:
    """(file, rendered) in one of the forms text, segments, srt, json."""
    r = F.col(result)
    forms = {"text": lambda: r["text"], "segments": lambda: as_segments(r["segments"]), "srt": lambda: as_srt(r["segments"]), "json": lambda: as_json(F.col(file), r)}
    return rows.select(file, forms[form]().alias("rendered"))


def joined_files(rows: DataFrame) -> Iterator[str]:
    """The rendered files in order of name, with a heading each if there are several; the driver holds one partition at a time."""
    several = rows.limit(2).count() > 1
    for r in rows.orderBy("file").toLocalIterator():
        yield f"=== {r['file']} ===\n{r['rendered']}\n" if several else r["rendered"]


def metrics_table(metrics: DataFrame) -> DataFrame:
    """(level, n, wer, cer, legacy) of metrics by level, the overall row first: percent with two places, a dash for what is missing;
    legacy is the older form's word and character rates."""
    shown = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.2f %%", 100 * F.col(c)))
    old = F.concat_ws(" / ", shown("wer_legacy"), shown("cer_legacy"))
    return metrics.orderBy(F.col("level") != "overall", "level").select("level", "n", shown("wer").alias("wer"), shown("cer").alias("cer"), old.alias("legacy"))
