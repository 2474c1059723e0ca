"""Audio: decoding, mixing down, resampling, features and speech detection, in Arrow-batched Python.

PCM WAV needs nothing but numpy; other formats go through soundfile where it is installed. Bytes stay undecoded until after
all filters, as decoding is the last step of a plan.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SAMPLE_RATE


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(float32 samples in [-1, 1), channels averaged; rate)."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    except wave.Error:
        import soundfile

        x, rate = soundfile.read(io.BytesIO(data), dtype="float32", always_2d=True)
        return x.mean(1).astype(np.float32), rate
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate


def encode_wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """PCM of 16 bits, one channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(samples: np.ndarray, rate: int, to: int = SAMPLE_RATE, half_width: int = 16) -> np.ndarray:
    """Band-limited interpolation by a Hann-windowed sinc; the same samples if the rates agree."""
    x = np.asarray(samples, np.float32)
    if rate == to or not len(x):
        return x
    cut = min(1.0, to / rate)
    n = int(np.ceil(len(x) * to / rate))
    at = np.arange(n) * (rate / to)
    reach = int(np.ceil(half_width / cut))
    padded = np.concatenate([np.zeros(reach, np.float32), x, np.zeros(reach + 1, np.float32)])
    out = np.empty(n, np.float32)
    for s in range(0, n, 16_384):  # bounds memory on long audio
        p = at[s : s + 16_384]
        k = np.floor(p).astype(np.int64)[:, None] + np.arange(-reach + 1, reach + 1)[None, :]
        d = (p[:, None] - k) * cut
        w = np.sinc(d) * np.where(np.abs(d) < half_width, 0.5 + 0.5 * np.cos(np.pi * d / half_width), 0) * cut
        out[s : s + 16_384] = (padded[np.clip(k + reach, 0, len(padded) - 1)] * w).sum(1)
    return out


def log_mel(samples: np.ndarray, rate: int = SAMPLE_RATE, bins: int = 80, low: float = 20.0, high_below_nyquist: float = 400.0) -> np.ndarray:
    """(frames, bins) log-mel energies: 25 ms frames every 10 ms with mirrored edges, DC removed, pre-emphasis 0.97, Povey window,
    power spectrum."""
    x = np.asarray(samples, np.float64)
    size, shift = int(rate * 0.025), int(rate * 0.010)
    frames = (len(x) + shift // 2) // shift
    if not frames:
        return np.empty((0, bins), np.float32)
    start = np.arange(frames) * shift + shift // 2 - size // 2
    k = start[:, None] + np.arange(size)[None, :]
    period = 2 * len(x)
    k = np.mod(k, period)
    f = x[np.where(k < len(x), k, period - 1 - k)]
    f = f - f.mean(1, keepdims=True)
    f = f - 0.97 * np.concatenate([f[:, :1], f[:, :-1]], 1)
    f = f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    n = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(f, n)) ** 2
    mel = lambda hz: 1127 * np.log1p(np.asarray(hz) / 700)
    edges = np.linspace(mel(low), mel(rate / 2 - high_below_nyquist), bins + 2)
    m = mel(np.arange(n // 2 + 1) * rate / n)[None, :]
    up, down = (m - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - m) / (edges[2:] - edges[1:-1])[:, None]
    weights = np.maximum(0, np.minimum(up, down))
    weights[:, -1] = 0
    return np.log(np.maximum(power @ weights.T, np.finfo(np.float32).eps)).astype(np.float32)


def speech_spans(samples: np.ndarray, rate: int = SAMPLE_RATE, level: float = 0.02, min_speech: float = 0.25, min_silence: float = 0.3) -> list[tuple[float, float]]:
    """Spans in seconds whose 10 ms level passes `level`; pauses below min_silence are bridged, spans below min_speech dropped."""
    step = rate // 100
    n = -(-len(samples) // step)
    x = np.zeros(n * step)
    x[: len(samples)] = samples
    loud = np.sqrt((x.reshape(n, step) ** 2).mean(1)) > level
    edge = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]])))
    out: list[list[float]] = []
    for s, e in zip(edge[::2] / 100, edge[1::2] / 100, strict=True):
        if out and s - out[-1][1] < min_silence:
            out[-1][1] = e
        else:
            out.append([s, e])
    total = len(samples) / rate
    return [(float(s), float(min(e, total))) for s, e in out if e - s >= min_speech]


def read_audio(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(path, content) of audio files, undecoded."""
    return spark.read.format("binaryFile").options(**options).load(path).select("path", "content")


def decoded(rows: DataFrame, content: str = "content", rate: int = SAMPLE_RATE) -> DataFrame:
    """rows with samples (array<float> at `rate`) and duration in place of content; content is bytes, or a struct with bytes.
    What cannot be decoded fails the job; null content has no samples."""
    if rows.schema[content].dataType.typeName() == "struct":
        rows = rows.withColumn(content, F.col(f"{content}.bytes"))

    @F.pandas_udf("samples array<float>, duration double")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [None if b is None else resample(*decode_wav(b), rate) for b in s]
            yield pd.DataFrame({"samples": found, "duration": [None if x is None else len(x) / rate for x in found]})

    rows = rows.withColumn("__audio", decode(content))
    return rows.select(*[c for c in rows.columns if c not in (content, "__audio")], "__audio.samples", "__audio.duration")


def with_features(rows: DataFrame, samples: str = "samples", to: str = "features") -> DataFrame:
    """rows with log_mel frames, array<array<float>>."""

    @F.pandas_udf("array<array<float>>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else list(log_mel(x)) for x in s], dtype=object)

    return rows.withColumn(to, features(samples))


def with_speech(rows: DataFrame, samples: str = "samples", to: str = "speech", detector=speech_spans) -> DataFrame:
    """rows with speech spans; detector takes samples to (start, end) pairs, and may hold a model."""

    @F.pandas_udf("array<struct<start: double, end: double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else [{"start": a, "end": b} for a, b in detector(x)] for x in s], dtype=object)

    return rows.withColumn(to, spans(samples))
