"""Command lines: `python -m cadenza.plans.cli score|report|transcribe|build ...`"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import audio, inference, metrics, reports, segments
from ..schema import RESULT
from ..sources import readers, sinks
from . import build

SCHEMA = "audio_file string, audio_path string, channel string, bucket string, duration double, ref string, hyp string"


def _factory(name: str):
    """module:function to a factory of a model."""
    module, _, f = name.partition(":")
    return getattr(importlib.import_module(module), f)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of a predictions CSV, overall and by bucket, as JSON."""
    overall, by = build.score(readers.read_predictions(spark, a.data, SCHEMA))
    m = overall.first().asDict()
    buckets = {r["bucket"]: {k: v for k, v in r.asDict().items() if k != "bucket"} for r in by.collect()}
    sinks.write_metrics(spark, a.out, m, buckets)
    print(a.data)
    reports.metrics_table(readers.read_metrics(spark, a.out)).show(truncate=False)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Worst and best rows, style and digit figures of a predictions CSV, against another one if given."""
    # A CSV with line breaks in its fields is never split, so this follows the order of its lines.
    read = lambda path: readers.read_predictions(spark, path, SCHEMA).withColumn("idx", F.monotonically_increasing_id())
    rows, other = read(a.csv), read(a.other) if a.other else None
    if a.row is not None:
        rows.where(F.col("idx") == a.row).show(1, truncate=False, vertical=True)
    for name, df in build.report(rows, other, a.n).items():
        print(f"--- {name} ---")
        df.show(a.n, truncate=False)
    if a.metrics and a.other_metrics:
        base, tuned = (readers.read_metrics(spark, p).where("level = 'overall'") for p in (a.other_metrics, a.metrics))
        metrics.before_after(base, tuned).show()


def transcribe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Audio files to text, segments, subtitles or JSON."""
    if a.punct and a.lower:
        sys.exit("--lower would undo the capitals of --punct")
    if a.out and len(a.audio) > 1:
        sys.exit("--out takes one input")
    rows = audio.decoded(audio.read_audio(spark, a.audio)).withColumnRenamed("path", "file")
    rows = rows if a.no_vad else audio.with_speech(rows)
    spans = segments.segment_spans(F.col("duration"), None if a.no_vad else F.col("speech"), a.max_seconds, a.chunk_seconds)
    rows = rows.withColumn("spans", spans)
    said = inference.transcribe_spans(rows, _factory(a.model), size=a.batch_size)
    if a.lower:
        said = said.withColumns({"text": F.lower("text"), "segments": F.transform("segments", lambda s: s.withField("text", F.lower(s["text"])))})
    if a.punct:
        said = inference.punctuated(said, _factory(a.punct))
    said = said.join(rows.select("file", "duration"), "file")
    result = F.struct("text", "segments", F.col("duration").alias("audio_seconds"), "elapsed_seconds").cast(RESULT)
    # Written once, so that counting, ordering and printing do not decode again.
    shown = sinks.kept(reports.rendered(said.withColumn("result", result), a.format))
    if a.out:
        sinks.put_text(spark, a.out, "\n".join(reports.joined_files(shown)))
    else:
        for text in reports.joined_files(shown):
            print(text)


def build_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """A split corpus from a table of source rows (idx, text, duration, path, ...)."""
    corpus = readers.CORPORA[a.corpus]
    job = lambda: build.prepare_corpus(spark, lambda: readers.standard_schema(spark.read.parquet(a.rows), corpus.text_column), corpus, a.out, a.hours, source=a.corpus)
    done, failed = build.prepare_all({a.corpus: job})
    if failed:
        sys.exit(json.dumps(failed))
    reports.split_table(done[a.corpus]).show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadenza")
    sub = p.add_subparsers(required=True)

    def command(f, *options):
        s = sub.add_parser(f.__name__.removesuffix("_corpus"), help=f.__doc__)
        s.set_defaults(run=f)
        for names, kw in options:
            s.add_argument(*names, **kw)

    command(score, (["--data"], {"required": True}), (["--out"], {"required": True}))
    command(report, (["--csv"], {"required": True}), (["--other"], {}), (["--metrics"], {}), (["--other-metrics"], {}), (["--n"], {"type": int, "default": 5}), (["--row"], {"type": int, "help": "shows this row of the CSV, from 0"}))
    command(
        transcribe, (["audio"], {"nargs": "+"}), (["--punct"], {"metavar": "FACTORY", "help": "module:factory of a model that restores punctuation"}), (["--model"], {"required": True, "help": "module:factory"}), (["--format"], {"choices": ["text", "segments", "srt", "json"], "default": "text"}),
        (["--out"], {}), (["--no-vad"], {"action": "store_true"}), (["--lower"], {"action": "store_true"}), (["--max-seconds"], {"type": float, "default": 25.0}),
        (["--chunk-seconds"], {"type": float, "default": 60.0}), (["--batch-size"], {"type": int, "default": 4}),
    )
    command(build_corpus, (["--corpus"], {"required": True, "choices": sorted(readers.CORPORA)}), (["--rows"], {"required": True}), (["--out"], {"required": True}), (["--hours"], {"type": float}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
