"""Jobs: build a corpus, assemble a mixture, score predictions, report. Each is a composition of the operators."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clips, metrics, reports, sampling, segments, splits
from ..schema import CLIP_COLUMNS, SAMPLE_RATE
from ..sources import sinks
from ..sources.readers import Corpus, reachable

VERSION = 3
VALIDATION_HOURS = 0.5


def clip_rows(rows: DataFrame, corpus: Corpus, hours: float | None = None, order: str = "idx", source: str | None = None) -> DataFrame:
    """Source rows (order, text, duration, path, columns of the corpus) to clips: capitals folded, trimmed, kept by length, up to the
    hours' budget, with channel and bucket. A row stays even for a budget of 0."""
    rows = rows.withColumn("text", F.trim(text.fold_capitals(F.coalesce("text", F.lit("")))))
    rows = rows.where(clips.keeps(F.col("duration"), F.col("text")))
    rows = sampling.take_hours(rows, order, hours, at_least_one=True)
    if corpus.channel_column:
        channel = text.column_channel(F.col(corpus.channel_column), corpus.strip_suffix)
    else:
        channel = text.path_channel(F.col("path")) if corpus.channel_from_path else F.lit("")
    return rows.withColumns({"channel": channel, "bucket": text.bucket(F.col("duration")), "source": F.lit(source)})


def measured(rows: DataFrame) -> DataFrame:
    """rows; where there are samples, duration is theirs."""
    return rows.withColumn("duration", F.size("samples") / float(SAMPLE_RATE)) if "samples" in rows.columns else rows


def with_audio(found: DataFrame, whole: DataFrame, base: str | None, name: str, digits: int = 7) -> DataFrame:
    """found (without samples) with audio_path: WAVs of the samples that `whole` has for its idx, below <base>_audio and numbered
    from 0 in order of idx; without samples, or a base, the path that rows came with, or null. Budgets and splits are settled on
    narrow rows, so samples are shuffled once. idx is unique."""
    if base is None or "samples" not in whole.columns:
        return found.withColumn("audio_path", next((F.col(c) for c in ("audio_path", "path") if c in found.columns), F.lit(None).cast("string")))
    folder = f"{base}_audio"
    found = sampling.dense_index(found.drop("audio_path"), "idx", "__i").join(whole.select("idx", "samples"), "idx")
    return sinks.write_wavs(found, folder, name, "__i", digits=digits).drop("__i").withColumn("audio_path", F.concat_ws("/", F.lit(folder), "audio_path"))


def prepare_corpus(spark: SparkSession, rows: Callable[[], DataFrame], corpus: Corpus, base: str, hours: float | None = None, seed: int = 42, source: str | None = None) -> DataFrame:
    """A corpus at base, built unless a complete cache of this version and these hours is there. rows is called only to build.
    Samples, if rows has them, are written as WAVs below <base>_audio, and clips last as long as their samples."""
    if not sinks.is_complete(spark, base, VERSION, hours, corpus.prebuilt is not None):
        whole = measured(rows())
        found = clip_rows(whole.drop("samples"), corpus, hours, source=source)
        found = splits.split_records(found, corpus.has_channels, seed)
        sinks.write_splits(with_audio(found, whole, base, source or "clip").select(*CLIP_COLUMNS, "split"), base, VERSION, hours)
    return spark.read.parquet(base)


def prepare_all(jobs: dict[str, Callable[[], DataFrame]], attempts: int = 3, wait: float = 60.0, probes: dict[str, Callable[[], DataFrame]] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Runs jobs one after the other; what fails is tried again, except on ValueError. (results, errors). A job whose probe (a function
    that returns its source's rows) yields nothing readable is not begun."""
    done, failed = {}, {}
    for name, job in jobs.items():
        if probes and name in probes:
            there, why = reachable(probes[name])
            if not there:
                failed[name] = why
                continue
        for k in range(attempts):
            try:
                done[name] = job()
                failed.pop(name, None)
                break
            except ValueError as e:
                failed[name] = str(e)
                break
            except Exception as e:  # any other fault of a source may pass
                failed[name] = str(e)
                if k + 1 < attempts:
                    time.sleep(wait)
    return done, failed


def prepare_mixture(sources: dict[str, DataFrame], caps: dict[str, float | None], hashed: set[str], validation: dict[str, DataFrame] | None = None, base: str | None = None) -> DataFrame:
    """Clips of all sources with source and split (samples as WAVs below <base>_audio, see with_audio): capitals folded, hours capped; sources in `hashed` are split by text, others
    train (or as their own split column says); official validation rows are capped at half an hour."""
    def one(name: str, whole: DataFrame, hours: float | None, split: str | None) -> DataFrame:
        whole = measured(whole)
        rows = sampling.take_hours(whole.drop("samples"), "idx", hours).withColumns({"text": text.fold_capitals(F.col("text")), "source": F.lit(name), "bucket": text.bucket(F.col("duration"))})
        if "split" not in rows.columns:
            rows = rows.withColumn("split", splits.hash_split(F.col("text")) if name in hashed else F.lit(split))
        rows = rows if "channel" in rows.columns else rows.withColumn("channel", F.lit(""))
        return with_audio(rows, whole, base, f"{name}_{split}").select(*CLIP_COLUMNS, "split")

    parts = [one(n, r, caps.get(n), "train") for n, r in sources.items()] + [one(n, r, VALIDATION_HOURS, "val") for n, r in (validation or {}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_mixture(spark: SparkSession, base: str, sources: dict[str, DataFrame], caps: dict[str, float | None], hashed: set[str], validation: dict[str, DataFrame] | None = None) -> DataFrame:
    """prepare_mixture written to base by split, with a stamp; the test rows of each hashed source also at <base>_test/<source>."""
    sinks.write_splits(prepare_mixture(sources, caps, hashed, validation, base), base, VERSION)
    out = spark.read.parquet(base)
    for name in sorted(hashed):
        sinks.write_held_out(out, name, f"{base}_test/{name}")
    return out


def native_dataset(rows: DataFrame, hours: float | None = 8.0, seed: int = 42, merge: bool = True, base: str | None = None) -> DataFrame:
    """Native clips (idx, text, duration, path, channel or none) to a split dataset; with merge, clips of a channel are joined to
    segments in order of their start. With samples and a base, segments' samples (with silence between clips) or the clips' are
    written as WAVs below <base>_audio, lazily, and durations are those of the samples."""
    whole = measured(rows)
    rows = whole.drop("samples").where(clips.streamable(F.col("duration"), F.col("text")))
    rows = rows if "channel" in rows.columns else sampling.chunk_channel(rows, "idx")
    rows = sampling.take_hours(rows, "idx", hours, at_least_one=True).withColumn("start", text.path_start(F.col("path")))
    if merge:
        from pyspark.sql import Window as W

        rows = rows.withColumn("place", F.row_number().over(W.partitionBy("channel").orderBy("start", "idx")).cast("long"))
        plan = segments.plan_segments(rows, "channel", "place", "duration", seed)
        said = segments.join_clips(rows, plan, "channel", "place")
        rows = rows.select("channel", "place", "idx")
        found = plan.join(said, ["channel", "seg_no"]).select("channel", "seg_no", "text", F.col("total").alias("duration"))
        # Segments are numbered by their first clip.
        first = rows.select("channel", F.col("place").alias("__first"), "idx")
        found = found.join(plan.select("channel", "seg_no", F.get("clips", F.lit(0)).alias("__first")), ["channel", "seg_no"]).join(first, ["channel", "__first"]).drop("__first")
        if base and "samples" in whole.columns:
            parts = plan.select("channel", "seg_no", F.explode("clips").alias("place")).join(rows, ["channel", "place"]).join(whole.select("idx", "samples"), "idx")
            parts = parts.groupBy("channel", "seg_no").agg(F.array_sort(F.collect_list(F.struct("place", "samples"))).alias("parts"))  # 60 s at most
            joined = parts.select("channel", "seg_no", segments.concat_samples(F.col("parts.samples")).alias("samples"))
            whole = measured(found.select("channel", "seg_no", "idx").join(joined, ["channel", "seg_no"]))
            found = found.drop("duration").join(whole.select("idx", "duration"), "idx")
        rows = found
    rows = rows.withColumn("bucket", text.bucket(F.col("duration")))
    rows = rows.join(splits.cut_channels(rows, "channel", seed), "channel")
    return with_audio(rows, whole, base, "seg" if merge else "clip", digits=6)


def score(predictions: DataFrame, by: str | None = "bucket") -> tuple[DataFrame, DataFrame]:
    """(overall, by group) error rates of (ref, hyp, ...)."""
    counts = metrics.edit_counts(predictions)
    overall = metrics.error_rates(counts)
    return overall, metrics.error_rates(counts, by) if by else overall.limit(0)


def run_benchmarks(predictions: DataFrame) -> DataFrame:
    """Error rates of all benchmarks in one job: predictions of all, with column dataset."""
    return metrics.error_rates(metrics.edit_counts(predictions), "dataset")


def report(predictions: DataFrame, other: DataFrame | None = None, n: int = 5, order: str = "idx") -> dict[str, DataFrame]:
    """What a results page shows: digit_report, worst and best rows, style, and per-row verdicts against another system."""
    counts = metrics.edit_counts(predictions).withColumns({"wer": metrics.row_rate(), "wer_legacy": metrics.row_rate("_legacy")})
    out = {"digits": metrics.digit_report(counts), "worst": metrics.extremes(counts, "wer", order, n), "best": metrics.extremes(counts, "wer", order, n, worst=False), "style": metrics.style_rates(predictions)}
    if "bucket" in predictions.columns:
        out["buckets"] = reports.value_counts(predictions, "bucket")
    aligned = None if other is None else metrics.align_by_key(counts, other) if "audio_file" in predictions.columns and "audio_file" in other.columns else metrics.align_by_position(counts, other, order)
    if aligned is not None:
        theirs = metrics.edit_counts(aligned.select(order, "ref", F.col("hyp_other").alias("hyp")), legacy=False).select(order, metrics.row_rate().alias("wer_other"))
        out["verdicts"] = aligned.join(theirs, order).withColumn("verdict", metrics.verdict(F.col("wer"), F.col("wer_other")))
    return out
