"""Leakage-safe splits: whole channels, or equal texts, never lie in two of train, val and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..schema import CHANNEL_RATIOS, HASH_RATIOS, MIN_CHANNELS, SPLITS
from .sampling import seeded


def hash_split(value: Column, ratios: tuple[float, ...] = HASH_RATIOS) -> Column:
    """train, val or test by the MD5 of the text in NFC, trimmed and in lower case, as a fraction of 2^128.

    Hex digits compare as numbers do, so the digest is compared with the shares' own hex digits.
    """
    digest = F.md5(F.lower(F.regexp_replace(text.nfc(F.coalesce(value, F.lit(""))), r"(?U)^\s+|\s+$", "")))
    out, upto = None, 0.0
    for name, share in zip(SPLITS[:-1], ratios, strict=False):
        upto += share
        edge = f"{int(upto * (1 << 128)):032x}"
        out = F.when(digest < edge, name) if out is None else out.when(digest < edge, name)
    return out.otherwise(SPLITS[-1])


def _ranked(rows: DataFrame, channel: str, seed: int | str) -> DataFrame:
    """Channels with their place in a seeded order and their number: one row per channel.

    The order is that of a hash, so channels are cut by its first digits: counts of the parts are added up (at most 4096 rows), and
    a window runs within a part. No task ranks all channels.
    """
    names = rows.select(channel).distinct().withColumn("__key", seeded(seed, channel)).withColumn("__part", F.substring("__key", 1, 3))
    counts = names.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", upto.alias("__base"), F.sum("__n").over(W.partitionBy()).alias("n"))
    within = F.row_number().over(W.partitionBy("__part").orderBy("__key", channel))
    placed = names.withColumn("__within", within).join(F.broadcast(counts), "__part")
    return placed.select(channel, (F.col("__base") + F.col("__within")).alias("place"), "n")


def allocate_channels(rows: DataFrame, channel: str = "channel", seed: int | str = 42, ratios: tuple[float, ...] = CHANNEL_RATIOS) -> DataFrame:
    """(channel, split): val and test get their share, rounded half to even, but one channel at least; train the rest.

    Fewer than 3 channels are an error.
    """
    if (n := rows.select(channel).distinct().limit(MIN_CHANNELS).count()) < MIN_CHANNELS:
        raise ValueError(f"only {n} channel(s); at least {MIN_CHANNELS} are needed for three splits")
    ranked = _ranked(rows, channel, seed)
    share = lambda r: F.greatest(F.lit(1), F.bround(F.lit(r) * F.col("n")).cast("int"))
    val, test = share(ratios[1]), share(ratios[2])
    return ranked.select(channel, F.when(F.col("place") <= val, "val").when(F.col("place") <= val + test, "test").otherwise("train").alias("split"))


def cut_channels(rows: DataFrame, channel: str = "channel", seed: int | str = 42, ratios: tuple[float, ...] = CHANNEL_RATIOS) -> DataFrame:
    """(channel, split) in the older way: train first, then val if two channels or more are left, test last; val and test may be empty."""
    ranked = _ranked(rows, channel, seed)
    share = lambda r: F.greatest(F.lit(1), F.bround(F.lit(r) * F.col("n")).cast("int"))
    train = share(ratios[0])
    val = F.when(F.col("n") - train >= 2, share(ratios[1])).otherwise(0)
    return ranked.select(channel, F.when(F.col("place") <= train, "train").when(F.col("place") <= train + val, "val").otherwise("test").alias("split"))


def split_records(rows: DataFrame, has_channels: bool, seed: int | str = 42, channel: str = "channel", value: str = "text") -> DataFrame:
    """rows with `split`: by whole channels if the corpus has them, else by text."""
    if not has_channels:
        return rows.withColumn("split", hash_split(F.col(value)))
    return rows.join(allocate_channels(rows, channel, seed), channel)


def shared_channels(rows: DataFrame, other: DataFrame, channel: str = "channel") -> DataFrame:
    """Channels in both."""
    return rows.select(channel).intersect(other.select(channel))


def unseen_channels(rows: DataFrame, train: DataFrame, channel: str = "channel") -> DataFrame:
    """rows of channels that train does not have."""
    return rows.join(train.select(channel).distinct(), channel, "left_anti")


def same_values(rows: DataFrame, other: DataFrame, col: str) -> bool:
    """Whether a column has the same set of values in both."""
    a, b = rows.select(col).distinct(), other.select(col).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.join(present, key, "left_anti")


def check_splits(rows: DataFrame, split: str = "split") -> None:
    """An empty split is an error."""
    there = {r[0] for r in rows.select(split).distinct().limit(10).collect()}
    if lacking := [s for s in SPLITS if s not in there]:
        raise ValueError(f"empty split(s): {lacking}")


def thin_splits(rows: DataFrame, least: int = 5, corpus: str = "source") -> DataFrame:
    """(corpus, split, channels) of test splits with fewer than `least` channels; corpora without channels ("") are left out."""
    found = rows.where("split = 'test' and channel <> ''").groupBy(corpus, "split").agg(F.count_distinct("channel").alias("channels"))
    return found.where(F.col("channels") < least)
