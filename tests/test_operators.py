"""Splits, budgets, segments, metrics and reports: golden values and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import audio, clips, inference, metrics, reports, sampling, segments, splits
from cadenza.operators.audio import decode_wav
from cadenza.plans import build
from cadenza.schema import CLIP_COLUMNS
from cadenza.sources import sinks
from cadenza.sources.readers import Corpus, benchmark_registry


def channels(spark, n):
    return spark.createDataFrame([(f"c{k}", f"text {k} {j}", 1.0) for k in range(n) for j in range(3)], "channel string, text string, duration double")


@pytest.mark.parametrize(("n", "want"), [(3, (1, 1, 1)), (20, (16, 2, 2)), (25, (21, 2, 2)), (35, (27, 4, 4))])
def test_allocate_channels(spark, n, want):
    got = dict(map(tuple, splits.allocate_channels(channels(spark, n)).groupBy("split").count().collect()))
    assert tuple(got[s] for s in ("train", "val", "test")) == want


def test_too_few_channels(spark):
    with pytest.raises(ValueError, match="2 channel"):
        splits.allocate_channels(channels(spark, 2))


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (2, 0, 0)), (10, (8, 1, 1))])
def test_cut_channels(spark, n, want):
    got = dict(map(tuple, splits.cut_channels(channels(spark, n)).groupBy("split").count().collect()))
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_no_channel_or_text_in_two_splits(spark):
    rows = splits.split_records(channels(spark, 30), True)
    assert rows.groupBy("channel").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    splits.check_splits(rows)
    with pytest.raises(ValueError, match="empty split"):
        splits.check_splits(rows.where("split <> 'val'"))
    by_text = splits.split_records(spark.createDataFrame([(f" Câu {k % 400} ", ) for k in range(800)], "text string"), False)
    shares = dict(map(tuple, by_text.groupBy("split").count().collect()))
    assert by_text.groupBy("text").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert 0.8 < shares["train"] / 800 < 0.97
    assert splits.same_values(rows, rows.limit(90), "channel") and not splits.same_values(rows, rows.where("channel <> 'c1'"), "channel")


def test_budget(spark):
    rows = spark.createDataFrame([(k, 1800.0) for k in range(3)], "idx long, duration double")
    count = lambda h, **o: sampling.take_hours(rows, "idx", h, **o).count()
    assert [count(0.75), count(0), count(None), count(0, at_least_one=True), count(0.5)] == [2, 0, 3, 1, 1]


def test_running_total_is_right_over_gaps(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(10**9), 500))
    rows = spark.createDataFrame([(i, rng.randrange(100)) for i in ids], "idx long, n long").repartition(5)
    total = 0
    for r in sampling.running_total(rows, "idx", "n").orderBy("idx").collect():
        assert r["before"] == total
        total += r["n"]
    assert sampling.running_total(rows.limit(0), "idx", "n").count() == 0


def test_batches_and_samples(spark):
    rows = spark.createDataFrame([(0, 5), (1, 1), (2, 3)], "idx long, length long")
    got = sampling.length_batches(rows, "length", "idx", 2)
    assert {r["idx"]: r["batch_id"] for r in got.collect()} == {1: 0, 2: 0, 0: 1}
    assert sampling.grouped_batches(rows, "length", "idx", 2, 1).select("batch_order").distinct().count() == 2
    many = spark.range(1000).withColumn("s", F.col("id") % 3)
    assert sampling.subsample(many, 10, 7, "id").collect() == sampling.subsample(many.repartition(9), 10, 7, "id").collect()
    assert sampling.subsample(many, 2000, 7, "id").count() == 1000
    assert [r["count"] for r in sampling.per_stratum(many, "s", 31, 7, "id").groupBy("s").count().collect()] == [10] * 3
    taken = [r["id"] for r in sampling.fraction(many, 0.05, 1, "id").collect()]
    assert sorted(taken) == sorted(r["id"] for r in many.orderBy(sampling.seeded(1, "id")).limit(50).collect())
    assert sampling.fraction(many, 1.0, 1, "id").count() == 1000 and sampling.fraction(many.limit(0), 0.5, 1, "id").count() == 0 and sampling.steps_per_epoch(100, 8, 4) == 4
    t = [r["t"] for r in many.select(sampling.target_duration(F.col("id").cast("string")).alias("t")).collect()]
    assert all(5 <= x < 60 for x in t) and 0.1 < np.mean([x >= 30 for x in t]) < 0.2


def test_segments_cover_and_stay_short(spark):
    rng = random.Random(3)
    rows = [(f"c{c}", k, rng.choice([1.0, 4.0, 20.0, 45.0, 70.0])) for c in range(20) for k in range(25)]
    df = spark.createDataFrame(rows, "channel string, idx long, duration double")
    dur = {(c, k): d for c, k, d in rows}
    for r in segments.plan_segments(df).collect():
        ks, ds = r["clips"], [dur[r["channel"], k] for k in r["clips"]]
        assert ks == list(range(ks[0], ks[0] + len(ks))) and r["total"] >= 5
        assert r["total"] == pytest.approx(sum(ds) + 0.3 * (len(ds) - 1)) and (len(ks) == 1 or r["total"] <= 60)


SPANS = [(0, 2), (2.5, 9), (9.2, 28), (28.5, 31), (40, 41), (41.5, 43)]


def test_merge_and_chunks(spark):
    one = spark.range(1)
    spans = F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in SPANS])
    pairs = lambda c: [(x["start"], x["end"]) for x in one.select(c.alias("x")).first()["x"]]
    assert pairs(segments.merge_intervals(spans, pad=0)) == [(0, 28), (28.5, 31), (40, 43)]
    assert pairs(segments.merge_intervals(spans, pad=0.2)) == [(0, 28.2), (28.3, 31.2), (39.8, 43.2)]
    assert pairs(segments.merge_intervals(F.slice(spans, 1, 0))) == []
    assert pairs(segments.fixed_chunks(F.lit(130.0))) == [(0, 60), (60, 120), (120, 130)]
    assert pairs(segments.fixed_chunks(F.lit(60.0))) == [(0, 60)]
    assert pairs(segments.segment_spans(F.lit(25.0), spans)) == [(0, 25)]
    assert pairs(segments.segment_spans(F.lit(50.0), spans, pad=0)) == [(0, 28), (28.5, 31), (40, 43)]
    assert pairs(segments.segment_spans(F.lit(70.0), F.slice(spans, 1, 0))) == [(0, 60), (60, 70)]
    x = F.array(*[F.lit(float(k)).cast("float") for k in range(10)])
    cut = lambda a, b: one.select(segments.slice_samples(x, F.lit(a), F.lit(b), 2).alias("x")).first()["x"]
    assert cut(1.0, 2.5) == [2, 3, 4] and cut(4.0, 99.0) == [8, 9] and cut(9.0, 10.0) == []
    joined = one.select(segments.concat_samples(F.array(F.slice(x, 1, 2), F.slice(x, 3, 1)), 10).alias("x")).first()["x"]
    assert joined == [0, 1, 0, 0, 0, 2]


def predictions(spark):
    rows = [(0, "a.wav", "một hai ba", "một ba", "0-5"), (1, "b.wav", "có 12 con", "có mười hai con", "0-5"), (2, "c.wav", "", "thừa", "5-30"), (3, "d.wav", "xin chào", "", "5-30"), (4, "e.wav", "Xin chào.", "xin chào", None)]
    return spark.createDataFrame(rows, "idx long, audio_file string, ref string, hyp string, bucket string")


def test_error_rates(spark):
    overall, by = build.score(predictions(spark))
    m = overall.first()
    assert (m["wer"], m["n"]) == (pytest.approx(3 / 11), 4) and m["wer_legacy"] == pytest.approx((1 + 2 + 2 + 0) / 10)
    rows = {r["bucket"]: r for r in by.collect()}
    assert set(rows) == {"0-5", "5-30"} and rows["5-30"]["wer"] == 1.0 and rows["5-30"]["n"] == 1
    counts = metrics.edit_counts(predictions(spark)).withColumn("wer", metrics.row_rate())
    assert [r["idx"] for r in metrics.extremes(counts, "wer", "idx", 5).collect()][-1] == 2
    assert [r["idx"] for r in metrics.extremes(counts, "wer", "idx", 2, worst=False).collect()] == [1, 4]


def test_alignment(spark):
    p = predictions(spark)
    other = p.withColumn("hyp", F.lit("x"))
    assert metrics.align_by_key(p, other).select("hyp_other").distinct().count() == 1
    assert metrics.align_by_key(p, other.where("idx > 0")) is None
    assert metrics.align_by_key(p, other.union(other.limit(1))) is None
    assert metrics.align_by_position(p, other) is not None
    assert metrics.align_by_position(p, other.withColumn("ref", F.lit("y"))) is None
    assert set(build.report(p, other)) == {"digits", "worst", "best", "style", "buckets", "verdicts"}


def test_comparisons(spark):
    rates = spark.createDataFrame([("cmv_vi", 0.1, 0.05, 0.1, 0.05, 9), ("vivos", 0.2, 0.1, 0.2, 0.1, 9)], "dataset string, wer double, cer double, wer_legacy double, cer_legacy double, n long")
    assert [r["dataset"] for r in metrics.summary_table(rates, benchmark_registry(spark)).collect()] == ["vivos", "cmv_vi"]
    with pytest.raises(KeyError, match="nosuch"):
        metrics.summary_table(rates.withColumn("dataset", F.lit("nosuch")), benchmark_registry(spark))
    got = {r["dataset"]: r for r in metrics.compare_named(rates.limit(1), rates).collect()}
    assert got["vivos"]["delta"] is None and got["cmv_vi"]["delta"] == 0
    counts = spark.createDataFrame([(k, 2 + k % 3, 10, k % 2, 10) for k in range(60)], "idx long, base_edits long, base_words long, tuned_edits long, tuned_words long")
    b = metrics.bootstrap(counts, 300).first()
    assert b["low"] < b["point"] < b["high"] < 0 and b["verdict"] == "significant" and b["point"] == pytest.approx(-25)


def test_reports(spark):
    s = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), F.lit("xin").alias("text")), F.struct(F.lit(2.0).alias("start"), F.lit(3.0).alias("end"), F.lit("chào").alias("text")))
    r = spark.range(1).select(F.lit("f").alias("file"), F.struct(F.lit("xin chào").alias("text"), s.alias("segments"), F.lit(3.0).alias("audio_seconds"), F.lit(0.3).alias("elapsed_seconds")).alias("result"))
    shown = {f: reports.rendered(r, f).first()["rendered"] for f in ("text", "segments", "srt", "json")}
    assert shown["segments"] == "[00:00:00.000 -> 00:00:01.500] xin\n[00:00:02.000 -> 00:00:03.000] chào"
    assert shown["srt"].startswith("1\n00:00:00,000 --> 00:00:01,500\nxin\n\n2\n")
    assert '"rtf":0.1' in shown["json"] and "chào" in shown["json"]
    both = reports.rendered(r, "text").union(reports.rendered(r, "text").withColumn("file", F.lit("a")))
    assert list(reports.joined_files(both)) == ["=== a ===\nxin chào\n", "=== f ===\nxin chào\n"] and list(reports.joined_files(both.where("file = 'a'"))) == ["xin chào"]
    assert reports.by_source(spark.createDataFrame([], "source string, duration double")).count() == 0
    levels = spark.createDataFrame([("5-30", 3, 0.1, 0.05, None, None), ("overall", 4, 0.25, None, 0.3, 0.2)], "level string, n long, wer double, cer double, wer_legacy double, cer_legacy double")
    assert list(map(tuple, reports.metrics_table(levels).collect())) == [("overall", 4, "25.00 %", "-", "30.00 % / 20.00 %"), ("5-30", 3, "10.00 %", "5.00 %", "- / -")]


def test_keeps(spark):
    rows = spark.createDataFrame([(0.5, "a"), (60.0, "a"), (0.49, "a"), (5.0, "  "), (None, "a"), (5.0, None)], "d double, t string")
    assert [r[0] for r in rows.select(clips.keeps(F.col("d"), F.col("t"))).collect()] == [True, True, False, False, False, False]


def test_corpus_build(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"CÂU SỐ {k}", 1.0 + k % 50, f"r{k % 9}_{k}.wav") for k in range(200)], "idx long, text string, duration double, path string")
    calls = []

    def source():
        calls.append(1)
        return rows

    base = str(tmp_path / "corpus")
    for _ in range(2):
        got = build.prepare_corpus(spark, source, Corpus(channel_from_path=True), base, 0.5, source="clip")
    assert len(calls) == 1
    assert got.agg(F.sum("duration")).first()[0] >= 1800 and got.where("text <> lower(text)").isEmpty()
    assert got.groupBy("channel").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    build.prepare_corpus(spark, source, Corpus(channel_from_path=True), base, None, source="clip")
    assert len(calls) == 2
    done, failed = build.prepare_all({"ok": lambda: 1, "bad": lambda: 1 / 0, "wrong": lambda: int("x")}, attempts=2, wait=0)
    assert done == {"ok": 1} and set(failed) == {"bad", "wrong"}


def test_builds_probe_sources_and_space(spark, tmp_path):
    probes = {"no": lambda: spark.read.parquet(str(tmp_path / "nosuch")), "yes": lambda: spark.range(1)}
    done, failed = build.prepare_all({"no": lambda: 1 / 0, "yes": lambda: 2, "free": lambda: 3}, wait=0, probes=probes)
    assert done == {"yes": 2, "free": 3} and set(failed) == {"no"} and "division" not in failed["no"]
    sinks.check_space(spark, str(tmp_path), 1)
    with pytest.raises(ValueError, match="are needed"):
        sinks.check_space(spark, str(tmp_path), 1 << 60)


def test_builds_write_audio_that_opens(spark, tmp_path):
    def opens(rows):
        rates = [decode_wav(open(r["audio_path"], "rb").read()) for r in rows.collect()]
        return all(rate == 16_000 for _, rate in rates) and sorted(len(x) / 16_000 for x, _ in rates) == sorted(r["duration"] for r in rows.collect())

    data = [(k, f"câu {k}", 99.0, f"r{k % 6}_{k}.wav", f"c{k % 6}") for k in range(72)]
    rows = spark.createDataFrame(data, "idx long, text string, duration double, path string, channel string")
    rows = rows.withColumn("samples", F.array_repeat(F.lit(0.25).cast("float"), ((F.col("idx") % 3 + 4) * 8000).cast("int")))
    got = build.prepare_corpus(spark, lambda: rows, Corpus(channel_from_path=True), str(tmp_path / "c"), source="clip")
    assert got.count() == 72 and opens(got)
    m = build.build_mixture(spark, str(tmp_path / "m"), {"a": rows, "b": rows.withColumn("path", F.lit("x"))}, {}, {"b"}, {"a": rows})
    assert m.count() == 216 and opens(m) and set(CLIP_COLUMNS) < set(m.columns) and m.select("audio_path").distinct().count() == 216
    held = spark.read.parquet(str(tmp_path / "m_test/b"))
    assert sorted(r["text"] for r in held.collect()) == sorted(r["text"] for r in m.where("source = 'b' and split = 'test'").collect())
    d = build.native_dataset(rows, None, base=str(tmp_path / "n"))
    written = sinks.kept(d)
    assert opens(written) and written.where("duration < 5 or duration > 60").isEmpty() and written.count() == written.select("audio_path").distinct().count() > 5
    assert all(r["audio_path"].startswith(f"{tmp_path}/n_audio/00000/seg_00") for r in written.collect())


def test_mixture_and_native_dataset(spark):
    rows = spark.createDataFrame([(k, f"câu {k}", 10.0, f"x_{k}.5_{k + 9}.wav") for k in range(300)], "idx long, text string, duration double, path string")
    m = build.prepare_mixture({"a": rows, "b": rows}, {"a": 0.1}, {"b"}, {"a": rows})
    assert dict(map(tuple, m.where("source = 'a'").groupBy("split").count().collect())) == {"train": 36, "val": 180}
    assert {r[0] for r in m.where("source = 'b'").select("split").distinct().collect()} == {"train", "val", "test"}
    d = build.native_dataset(rows.withColumn("channel", F.concat(F.lit("c"), (F.col("idx") % 10).cast("string"))), 0.5)
    assert d.where("duration > 60 or duration < 5").isEmpty() and d.groupBy("channel").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert build.native_dataset(rows, 0.5, merge=False).count() == 180


def test_audio(spark):
    t = np.arange(8000) / 8000
    x = (0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)
    y, rate = audio.decode_wav(audio.encode_wav(x, 8000))
    assert rate == 8000 and np.abs(x - y).max() < 1e-3
    up = audio.resample(x, 8000)
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(up) == 16000 and np.abs(up - want)[200:-200].max() < 1e-2
    f = audio.log_mel(up)
    assert f.shape == (100, 80) and f.dtype == np.float32 and np.ptp(f[10:-10].argmax(1)) == 0
    noise = np.concatenate([np.zeros(8000), np.tile([0.5, -0.5], 4000), np.zeros(8000)])
    assert audio.speech_spans(noise) == [(0.5, 1.0)]
    rows = spark.createDataFrame([("a", bytearray(audio.encode_wav(x, 8000))), ("b", None)], "path string, content binary")
    got = {r["path"]: r for r in audio.with_features(audio.decoded(rows)).collect()}
    assert got["a"]["duration"] == 1.0 and len(got["a"]["features"]) == 100 and got["b"]["samples"] is None
    assert audio.with_speech(audio.decoded(rows)).count() == 2


def test_inference(spark):
    rows = spark.createDataFrame([(k, [float(k)] * (1 + k * 7 % 5)) for k in range(20)], "idx long, samples array<float>")

    def factory():
        return lambda batch: [f"{int(x[0])}:{len(x)}" for x in batch]

    got = {r["idx"]: r["hyp"] for r in inference.transcribe(rows, factory, size=3).collect()}
    assert got == {k: f"{k}:{1 + k * 7 % 5}" for k in range(20)}
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0.0, 1.0), (1.0, 2.0))])
    r = spark.createDataFrame([("f", [1.0, 1.0, 2.0, 2.0]), ("g", [])], "file string, samples array<float>").withColumn("spans", F.when(F.col("file") == "f", spans).otherwise(F.slice(spans, 1, 0)))
    out = {x["file"]: x for x in inference.transcribe_spans(r, factory, rate=2).collect()}
    assert out["f"]["elapsed_seconds"] >= 0 and out["g"]["elapsed_seconds"] == 0.0
    assert out["f"]["text"] == "1:2 2:2" and len(out["f"]["segments"]) == 2 and out["g"]["text"] == ""
    assert inference.greedy_search(np.array([[0, 1, 0], [1, 0, 0], [0, 0, 1]]), lambda s: s, lambda f, s: f) == [1, 2]
    p = spark.createDataFrame([(0, "XIN CHÀO"), (1, " "), (2, None)], "k int, text string")
    said = [x["text"] for x in inference.punctuated(p, lambda: lambda ts: [t.capitalize() + "." for t in ts]).orderBy("k").collect()]
    assert said == ["Xin chào.", " ", None]
