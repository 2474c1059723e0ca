"""Structured Streaming over files: the batch operators' counterparts for tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_growing(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 2) -> DataFrame:
    """Parquet files as they come, a few at a time (the window of shards under way)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, value): sessions with pauses below gap; those that the watermark has passed are final."""
    session = F.session_window(F.col(at), gap)
    by = events.withWatermark(at, late).groupBy(session.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def tumbling(events: DataFrame, at: str = "ts", width: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """(start, end, n): fixed chunks of time."""
    by = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


SEGMENT = "channel string, seg_no long, start double, end double, n long"
STATE = "seg_no long, start double, end double, n long"


def merged_spans(spans: DataFrame, max_seconds: float = 30.0, max_gap: float = 0.8) -> DataFrame:
    """Interval merging with state: spans (channel, start, end), in order within a channel, to merged segments. A segment goes out
    once a span of its channel does not fit it, or when the channel ends: a row with a null start marks that, after all spans of its
    batch (`end_of` makes such rows). An ended channel leaves no state."""

    def step(key, batches, state):
        import pandas as pd

        out = []
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["start", "end"])
        spans = rows[rows["start"].notna()]
        for s, e in zip(spans["start"], spans["end"], strict=True):
            if now and e - now[1] <= max_seconds and s - now[2] <= max_gap:
                now = [now[0], now[1], e, now[3] + 1]
            else:
                if now:
                    out.append((key[0], *now))
                now = [now[0] + 1 if now else 0, s, e, 1]
        if len(spans) < len(rows):
            if now:
                out.append((key[0], *now))
            if state.exists:
                state.remove()
        elif now:
            state.update(tuple(now))
        yield pd.DataFrame(out, columns=["channel", "seg_no", "start", "end", "n"])

    return spans.groupBy("channel").applyInPandasWithState(step, SEGMENT, STATE, "append", "NoTimeout")


def end_of(channels: DataFrame) -> DataFrame:
    """Rows that end channels for merged_spans: (channel, start, end), without times."""
    return channels.select("channel", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")).distinct()


def write_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what is there, once, and remembers it: a later call goes on from that point."""
    query = rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
