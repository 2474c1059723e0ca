"""Budgets, subsamples and batches. Orders are total and seeds are hashed, so results do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a table whose sums are taken before any row is ordered against rows of another part.
PARTS = 1024


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def seeded(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def running_total(rows: DataFrame, order: str, amount: str, to: str = "before", parts: int = PARTS) -> DataFrame:
    """rows with the sum of `amount` over all rows before (by `order`, a number without ties; null amounts are 0).

    Two levels: rows are cut by ranges of `order` into parts; sums of parts are added up (a few rows), and within a part a
    window runs. So no task orders the whole table.
    """
    span = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if span["lo"] is None:
        return rows.withColumn(to, F.lit(0.0))
    width = max((float(span["hi"]) - float(span["lo"])) / parts, 1e-12)
    rows = rows.withColumn("__part", F.least(F.floor((F.col(order) - F.lit(span["lo"])) / width), F.lit(parts - 1)).cast("int"))
    sums = rows.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sums), "__part").withColumn(to, F.col("__base") + inside).drop("__part", "__base")  # at most `parts` rows


def take_until(rows: DataFrame, order: str, amount: str, budget: float | None, at_least_one: bool = False) -> DataFrame:
    """Rows in order while the sum before them is below the budget, so the row that crosses it is in. None takes all, 0 none
    (or the first row, with at_least_one)."""
    if budget is None:
        return rows
    rows = running_total(rows, order, amount, "__before")
    keep = F.col("__before") < budget
    if at_least_one:
        first = rows.agg(F.min(order)).first()[0]
        keep = keep | (F.col(order) == F.lit(first))
    return rows.where(keep).drop("__before")


def take_hours(rows: DataFrame, order: str, hours: float | None, amount: str = "duration", at_least_one: bool = False) -> DataFrame:
    return take_until(rows, order, amount, None if hours is None else hours * 3600.0, at_least_one)


def dense_index(rows: DataFrame, order: str, to: str = "idx") -> DataFrame:
    """rows numbered from 0 in order."""
    return running_total(rows.withColumn("__one", F.lit(1)), order, "__one", to).withColumn(to, F.col(to).cast("long")).drop("__one")


def chunk_channel(rows: DataFrame, order: str, size: int = 200, to: str = "channel") -> DataFrame:
    """chunk0, chunk1, ... of `size` rows each, in order."""
    return dense_index(rows, order, "__idx").withColumn(to, F.concat(F.lit("chunk"), F.floor(F.col("__idx") / size).cast("string"))).drop("__idx")


def subsample(rows: DataFrame, limit: int | None, seed: int | str, *keys: str) -> DataFrame:
    """All rows if there are no more than limit, else the first by seeded hash of the keys."""
    if limit is None or rows.limit(limit + 1).count() <= limit:
        return rows
    return rows.orderBy(seeded(seed, *keys), *keys).limit(limit)


def fraction(rows: DataFrame, share: float, seed: int | str, *keys: str, least: int = 2) -> DataFrame:
    """A share of the rows, rounded down (`least` at least): the first by seeded hash of the keys.

    Rows are counted by the first four digits of the hash (at most 65,536 counts). Those below the digits where the share ends are
    taken by a filter; only rows with these very digits are ordered.
    """
    rows = rows.withColumn("__key", seeded(seed, *keys))
    digits = F.substring("__key", 1, 4)
    counts = sorted(rows.groupBy(digits.alias("d")).count().collect())
    rest = max(least, int(sum(n for _, n in counts) * share))
    for edge, n in counts:
        if rest <= n:
            last = rows.where(digits == edge).orderBy("__key", *keys).limit(rest)
            return rows.where(digits < edge).unionByName(last).drop("__key")
        rest -= n
    return rows.drop("__key")


def per_stratum(rows: DataFrame, stratum: str, total: int, seed: int | str, *keys: str) -> DataFrame:
    """total // strata rows of each stratum, by seeded hash of the keys."""
    k = total // max(1, rows.select(stratum).distinct().count())
    order = W.partitionBy(stratum).orderBy(seeded(seed, *keys), *keys)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def shuffled(rows: DataFrame, seed: int | str, *keys: str) -> DataFrame:
    return rows.orderBy(seeded(seed, *keys), *keys)


def length_batches(rows: DataFrame, length: str, index: str, size: int, parts: int = 256) -> DataFrame:
    """rows with batch_id: batches of `size` by length, ties by index, so that a batch pads little.

    Ranks come from counts of each length (a small table) and a window within one length, cut by ranges of the index.
    """
    span = rows.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).first() if isinstance(rows.schema[index].dataType, T.IntegralType) else None
    part = F.lit(0)  # an index that is no number has no ranges
    if span is not None and span["lo"] is not None:
        part = F.floor((F.col(index) - F.lit(span["lo"])) / ((span["hi"] - span["lo"]) // parts + 1)).cast("int")
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy(length, "__part").agg(F.count("*").alias("__n"))  # one row per length and range
    before = F.sum("__n").over(W.orderBy(length, "__part").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select(F.col(length).alias("__bylen"), F.col("__part").alias("__bypart"), F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.row_number().over(W.partitionBy(length, "__part").orderBy(index)) - 1
    rows = rows.withColumn("__within", within).join(base, F.col(length).eqNullSafe(F.col("__bylen")) & (F.col("__part") == F.col("__bypart")))
    return rows.withColumn("batch_id", F.floor((F.col("__base") + F.col("__within")) / size).cast("long")).drop("__bylen", "__bypart", "__part", "__base", "__within")


def grouped_batches(rows: DataFrame, length: str, index: str, size: int, seed: int | str) -> DataFrame:
    """length_batches with batches in a random, seeded order: column batch_order to sort by."""
    return length_batches(rows, length, index, size).withColumn("batch_order", seeded(seed, "batch_id"))


def target_duration(key: Column, long_share: float = 0.15) -> Column:
    """A target length in seconds: 30 to 60 with probability long_share, else 5 to 30."""
    u = uniform(F.concat(key, F.lit("a")))
    v = uniform(F.concat(key, F.lit("b")))
    return F.when(u < long_share, 30 + 30 * v).otherwise(5 + 25 * v)


def steps_per_epoch(n: int, batch: int, accumulate: int) -> int:
    return math.ceil(n / (batch * accumulate))
