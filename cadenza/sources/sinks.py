"""Sinks: split corpora with a stamp, predictions, metrics, audio files. All writes go through Spark or pyarrow's file systems."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audio import encode_wav
from ..operators.splits import check_splits
from ..schema import FILES_PER_DIR, SAMPLE_RATE

STAMP = "_STAMP.json"


def write_splits(rows: DataFrame, base: str, version: int, hours: float | None = None, mode: str = "overwrite") -> None:
    """rows (with split) as Parquet by split; the stamp is written last, so a build that broke off or has an empty split (an error)
    has none."""
    spark = rows.sparkSession
    remove(spark, f"{base}/{STAMP}")
    rows.write.mode(mode).partitionBy("split").parquet(base)
    check_splits(spark.read.parquet(base))
    put_text(spark, f"{base}/{STAMP}", json.dumps({"version": version, "hours": hours_tag(hours)}))


def write_held_out(rows: DataFrame, source: str, path: str) -> None:
    """The test rows of one source."""
    rows.where((F.col("split") == "test") & (F.col("source") == source)).write.mode("overwrite").parquet(path)


def hours_tag(hours: float | None) -> str:
    return "all" if hours is None else f"{hours:g}"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def check_space(spark: SparkSession, path: str, least: int) -> None:
    """An error if the store that holds path says it has fewer than `least` bytes left; a store without limits says so too."""
    where, fs = _path(spark, path)
    if (left := fs.getStatus(where).getRemaining()) < least:
        raise ValueError(f"{left} bytes are left at {path}; {least} are needed")


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def put_text(spark: SparkSession, path: str, value: str) -> None:
    """Writes beside the path and renames."""
    where, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(value.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(beside, where)


def get_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    return spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(where), "UTF-8")


def stamp_of(spark: SparkSession, base: str) -> tuple[int, str | None]:
    """(version, hours); (0, None) if there is none that can be read."""
    try:
        found = json.loads(get_text(spark, f"{base}/{STAMP}") or "")
        return int(found["version"]), found.get("hours")
    except (ValueError, KeyError, TypeError):
        return 0, None


def is_complete(spark: SparkSession, base: str, version: int, hours: float | None, prebuilt: bool = False) -> bool:
    """Whether a cache can be used as it is: all splits are there, and the stamp has this version and these hours; a prebuilt one
    needs no stamp."""
    where, fs = _path(spark, base)
    if not all(fs.exists(_path(spark, f"{base}/split={s}")[0]) for s in ("train", "val", "test")):
        return False
    return prebuilt or stamp_of(spark, base) == (version, hours_tag(hours))


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_metrics(spark: SparkSession, path: str, overall: dict, by_bucket: dict | None = None) -> None:
    put_text(spark, path, json.dumps({"overall": overall, "by_bucket": by_bucket or {}}, ensure_ascii=False))


def write_named_metrics(spark: SparkSession, path: str, metrics: DataFrame, key: str = "dataset") -> None:
    """The flat form, {name: metrics}, of one row per benchmark."""
    found = {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in metrics.orderBy(key).toLocalIterator()}
    put_text(spark, path, json.dumps(found, ensure_ascii=False, indent=2))


def kept(rows: DataFrame) -> DataFrame:
    """rows written to the folder that the cluster names in spark.checkpoint.dir, and read again; on one machine a folder of its own."""
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        folder = tempfile.mkdtemp()
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def audio_path(name: str = "clip", index: str = "idx", digits: int = 7):
    """Column: <5 digits of index / 1000>/<name>_<digits of index>.wav"""
    return F.format_string(f"%05d/{name}_%0{digits}d.wav", F.floor(F.col(index) / FILES_PER_DIR).cast("long"), F.col(index))


def write_wavs(rows: DataFrame, folder: str, name: str = "clip", index: str = "idx", samples: str = "samples", rate: int = SAMPLE_RATE, digits: int = 7) -> DataFrame:
    """Writes a WAV per row below folder (a URI that executors share); rows with audio_path (below folder) in place of samples,
    lazily: count or write it once. Files are named by index, so a task that runs again writes the same ones."""
    rows = rows.withColumn("audio_path", audio_path(name, index, digits))
    schema = T.StructType([f for f in rows.schema.fields if f.name != samples])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, x in zip(b.audio_path, b[samples], strict=True):
                fs.create_dir(f"{root}/{path.rsplit('/', 1)[0]}")
                beside = f"{root}/{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(beside, compression=None) as out:
                    out.write(encode_wav(np.asarray(x, np.float32), rate))
                fs.move(beside, f"{root}/{path}")
            yield b[schema.names]

    return rows.mapInPandas(run, schema)
