"""Command lines end to end."""

import json

import numpy as np
import pytest

from cadenza.operators.audio import encode_wav
from cadenza.plans import cli
from cadenza.sources import sinks


def model():
    return lambda batch: [f"LEN {len(x)}" for x in batch]


def capitals():
    return lambda texts: [t.capitalize() for t in texts]


def test_score_and_report(spark, tmp_path, capsys):
    rows = [("a.wav", "d/a.wav", "c", "0-5", 2.0, "một hai", "một ba"), ("b.wav", "d/b.wav", "c", "5-30", 9.0, "x", "")]
    df = spark.createDataFrame(rows, cli.SCHEMA)
    data, out = str(tmp_path / "p"), str(tmp_path / "m.json")
    sinks.write_predictions(df, data)
    cli.main(["score", "--data", data, "--out", out], spark)
    found = json.loads(sinks.get_text(spark, out))
    assert found["overall"]["n"] == 2 and found["overall"]["wer"] == pytest.approx(2 / 3) and set(found["by_bucket"]) == {"0-5", "5-30"}
    cli.main(["report", "--csv", data, "--other", data, "--metrics", out, "--other-metrics", out], spark)
    cli.main(["report", "--csv", data, "--row", "0"], spark)
    said = capsys.readouterr().out
    assert "-RECORD 0-" in said and "--- worst ---" in said and "same" in said and "WER" in said


def test_transcribe(spark, tmp_path, capsys):
    for name, n in (("a", 16_000), ("b", 8_000)):
        (tmp_path / f"{name}.wav").write_bytes(encode_wav(np.zeros(n)))
    cli.main(["transcribe", str(tmp_path), "--model", f"{__name__}:model", "--no-vad", "--lower"], spark)
    said = capsys.readouterr().out
    assert "len 16000" in said and "len 8000" in said and said.count("===") == 4
    a, b = str(tmp_path / "a.wav"), str(tmp_path / "b.wav")
    cli.main(["transcribe", a, b, "--model", f"{__name__}:model", "--no-vad", "--punct", f"{__name__}:capitals", "--format", "json"], spark)
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["text"] for x in found] == ["Len 16000", "Len 8000"] and all(x["elapsed_seconds"] < 5 for x in found)
    cli.main(["transcribe", a, "--model", f"{__name__}:model", "--no-vad", "--out", str(tmp_path / "t.txt")], spark)
    assert (tmp_path / "t.txt").read_text() == "LEN 16000"
    for wrong in (["--punct", "x:y", "--lower"], ["--out", "t"]):
        with pytest.raises(SystemExit):
            cli.main(["transcribe", a, b, "--model", f"{__name__}:model", *wrong], spark)


def test_build(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(k, f"câu {k}", 3.0, f"r{k % 6}_{k}.wav") for k in range(60)], "idx long, transcription string, duration double, path string")
    rows.write.parquet(str(tmp_path / "rows"))
    cli.main(["build", "--corpus", "vietspeech", "--rows", str(tmp_path / "rows"), "--out", str(tmp_path / "c")], spark)
    assert "vietspeech" in capsys.readouterr().out
