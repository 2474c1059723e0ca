"""Readers, sinks and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators.audio import decode_wav
from cadenza.sources import readers, sinks
from cadenza.streaming import sessions


def test_pick():
    assert readers.pick(["x", "sentence", "text"], readers.TEXT_COLUMNS) == "sentence"
    assert readers.pick(["x", "sentence", "text"], readers.NATIVE_TEXT_COLUMNS) == "text"
    assert readers.pick(["x", "y"], readers.TEXT_COLUMNS, "y") == "y"
    with pytest.raises(KeyError):
        readers.pick(["x"], readers.TEXT_COLUMNS)
    with pytest.raises(KeyError):
        readers.pick(["text"], readers.TEXT_COLUMNS, "z")


def test_shards(spark, tmp_path):
    assert readers.shards_of(["data/train-0.parquet", "data/test-0.parquet", "x.md"], "train") == ["data/train-0.parquet"]
    assert readers.shards_of(["data-1.arrow", "data-0.arrow"], "train") == ["data-0.arrow", "data-1.arrow"]
    assert [readers.prefetch_window(n, 8) for n in (None, 1, 10**9, 10**11)] == [2, 8, 4, 1]
    for s in ("train", "test"):
        spark.range(20).coalesce(1).write.parquet(str(tmp_path / f"{s}-0"))
    root = str(tmp_path)
    assert readers.read_shards(spark, root, "train").count() == 20
    assert readers.read_shards(spark, root, "train", 5, seed=1).collect() == readers.read_shards(spark, root, "train", 5, seed=1).collect()
    seeded = lambda: readers.read_shards(spark, root, "train", seed=1)
    before = [r["id"] for r in seeded().collect()]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert [r["id"] for r in seeded().collect()] == before and before != sorted(before)
        assert [r["id"] for r in readers.read_shards(spark, root, "train", 7).collect()] == list(range(7))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert readers.read_shards(spark, root, "train", 0).count() == 0
    assert readers.reachable(lambda: spark.read.parquet(f"{root}/nosuch"))[0] is False
    assert readers.reachable(lambda: spark.range(1)) == (True, "ok")


def test_checkpoints():
    assert readers.latest_checkpoint(["adapter_config.json"]) == ""
    assert readers.latest_checkpoint([f"checkpoint-{n}/adapter_config.json" for n in (5, 100, 20)] + ["checkpoint-900/x"]) == "checkpoint-100"
    with pytest.raises(FileNotFoundError):
        readers.latest_checkpoint(["a"])


def test_predictions_round_trip(spark, tmp_path):
    rows = [("a.wav", 'x "q", y', ""), ("b.wav", "two\nlines", "h"), ("c.wav", "đ", "z\\")]
    df = spark.createDataFrame(rows, "audio_file string, ref string, hyp string")
    sinks.write_predictions(df, str(tmp_path / "p"))
    got = readers.read_predictions(spark, str(tmp_path / "p"), "audio_file string, ref string, hyp string")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_metrics_files(spark, tmp_path):
    m = {"wer": 0.1, "cer": 0.05, "wer_legacy": 0.2, "cer_legacy": 0.1, "n": 7}
    path = str(tmp_path / "m.json")
    sinks.write_metrics(spark, path, m, {"0-5": m})
    assert {r["level"]: r["n"] for r in readers.read_metrics(spark, path).collect()} == {"overall": 7, "0-5": 7}
    sinks.put_text(spark, path, json.dumps({"vivos": m, "x": m}))
    assert [r["level"] for r in readers.read_metrics(spark, path, "vivos").collect()] == ["overall"]
    sinks.write_named_metrics(spark, path, spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 4)], "dataset string, wer double, n long"))
    assert json.loads(sinks.get_text(spark, path)) == {"a": {"wer": 0.5, "n": 2}, "b": {"wer": 0.25, "n": 4}}
    assert readers.read_metrics(spark, path, "b").first()["n"] == 4
    assert readers.read_metrics(spark, path, "nosuch") is None and readers.read_metrics(spark, path + "x") is None


def test_tokens(spark, tmp_path):
    (tmp_path / "t.txt").write_text("<blk> 0\n▁a 1\n  2\n\nb c 3\n")
    assert [tuple(r) for r in readers.read_tokens(spark, str(tmp_path / "t.txt")).collect()] == [(0, "<blk>"), (1, "▁a"), (2, " "), (3, "b c")]


def test_stamps(spark, tmp_path):
    base = str(tmp_path / "c")
    rows = spark.createDataFrame([("t", 1.0, s, "a") for s in ("train", "val", "test")], "text string, duration double, split string, source string")
    assert sinks.stamp_of(spark, base) == (0, None) and not sinks.is_complete(spark, base, 3, None)
    sinks.write_splits(rows, base, 3, 100.0)
    assert sinks.stamp_of(spark, base) == (3, "100")
    assert [sinks.is_complete(spark, base, *x) for x in ((3, 100.0), (3, None), (2, 100.0))] == [True, False, False]
    assert sinks.is_complete(spark, base, 9, None, prebuilt=True)
    assert [sinks.hours_tag(h) for h in (None, 100.0, 0.5)] == ["all", "100", "0.5"]
    assert spark.read.parquet(base).where("split = 'val'").count() == 1
    sinks.write_held_out(spark.read.parquet(base), "a", str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1


def test_wavs(spark, tmp_path):
    rows = spark.createDataFrame([(k, [0.1 * (k % 3)] * 10) for k in (0, 999, 1000)], "idx long, samples array<float>")
    written = sinks.write_wavs(rows.withColumn("text", F.lit("t")), f"file://{tmp_path}", "v")
    assert written.columns == ["idx", "text", "audio_path"]
    got = sorted(r["audio_path"] for r in written.collect())
    assert got == ["00000/v_0000000.wav", "00000/v_0000999.wav", "00001/v_0001000.wav"]
    x, rate = decode_wav((tmp_path / got[2]).read_bytes())
    assert rate == 16_000 and np.allclose(x, 0.1, atol=1e-3)


def test_sessions_stream_as_in_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.expr("timestamp'2100-01-01'")
    events.orderBy("ts").coalesce(1).write.parquet(str(src))
    events.limit(1).withColumn("ts", last).coalesce(1).write.mode("append").parquet(str(src))
    out, check = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = lambda: sessions.event_sessions(sessions.read_growing(spark, str(src), events.schema, 10))
    for _ in range(2):
        sessions.write_available(stream(), out, check)
    batch = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    key = lambda df: sorted((r["user_id"], r["n"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch.where("w.start < '2099-01-01'"))


def test_spans_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("c", 0.0, 2.0), ("c", 2.5, 9.0), ("c", 40.0, 41.0), ("c", 80.0, 81.0)]
    spark.createDataFrame(rows, "channel string, start double, end double").coalesce(1).write.parquet(str(src))
    stream = sessions.merged_spans(sessions.read_growing(spark, str(src), "channel string, start double, end double"))
    sessions.write_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["start"], r["end"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0.0, 9.0, 2), (40.0, 41.0, 1)]


def test_ended_channels_leave_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spans = spark.createDataFrame([("c", 0.0, 2.0), ("c", 2.5, 9.0), ("c", 40.0, 41.0), ("d", 1.0, 2.0)], "channel string, start double, end double")
    spans.coalesce(1).write.parquet(src)
    run = lambda: sessions.write_available(sessions.merged_spans(sessions.read_growing(spark, src, spans.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    found = lambda: sorted((r["channel"], r["seg_no"], r["start"], r["end"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run()
    assert found() == [("c", 0, 0.0, 9.0)]
    sessions.end_of(spans).coalesce(1).write.mode("append").parquet(src)
    run()
    assert found() == [("c", 0, 0.0, 9.0), ("c", 1, 40.0, 41.0), ("d", 0, 1.0, 2.0)]
    spans.where("channel = 'd'").unionByName(sessions.end_of(spans.where("channel = 'd'"))).coalesce(1).write.mode("append").parquet(src)
    run()
    assert found()[-2:] == [("d", 0, 1.0, 2.0)] * 2


def test_tumbling_stream(spark, sf, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(src))
    sessions.write_available(sessions.tumbling(sessions.read_growing(spark, str(src), events.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.schema("start timestamp, end timestamp, n long").parquet(str(tmp_path / "out")).where("n < 1").isEmpty()


def test_predictions_are_read_by_name(spark, tmp_path):
    import pytest

    from cadenza.schema import PREDICTION
    from cadenza.sources import readers

    layouts = {
        "split": "audio_file,audio_path,channel,bucket,duration,ref,hyp\nx.wav,a/x.wav,c,5-30,6.5,xin chao,\n",
        "corpus": "dataset,audio_path,channel,bucket,duration,ref,hyp\nvivos,a/x.wav,c,5-30,6.5,xin chao,\n",
        "benchmark": "dataset,duration,ref,hyp\nvivos,6.5,xin chao,\n",
    }
    for name, lines in layouts.items():
        (tmp_path / f"{name}.csv").write_text(lines)
        r = readers.read_predictions(spark, f"file://{tmp_path}/{name}.csv", PREDICTION).first()
        assert (r["ref"], r["hyp"], r["duration"]) == ("xin chao", "", 6.5) and list(r.asDict()) == lines.split("\n")[0].split(",")
    (tmp_path / "bad.csv").write_text("dataset,ref\nvivos,a\n")
    with pytest.raises(KeyError):
        readers.read_predictions(spark, f"file://{tmp_path}/bad.csv", PREDICTION)


def test_long_arrays_of_spans_merge_once(spark):
    from pyspark.sql import functions as F

    from cadenza.operators import segments

    spans = F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda k: F.struct((k * 10.0).alias("start"), (k * 10.0 + 2).alias("end")))
    got = spark.range(1).select(segments.merge_intervals(spans).alias("m")).first()["m"]
    assert len(got) == 5000 and tuple(got[0]) == (0.0, 2.2) and tuple(got[-1]) == (49_989.8, 49_992.2)
