r"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target in words is its weight's share of the total, at most `max_repeat` times its own size; what is above
goes to the others by weight (water-filling over the sorted caps). target = c * size + rest with whole c: each document is
taken c times for certain, and the rest is a sample of fixed size (in words) without replacement, with inclusion
probabilities in proportion to size: p = min(1, g * size), where g is such that the sum of p * size is the rest. Documents
with p = 1 are certain; a document longer than the rest can't be in it and has no p. Documents are ranked by the odds of a
uniform number over the odds p / (1 - p), and the sample is the longest prefix of this order whose words fit in the rest. If
more than `NEAR` of the rest is then open (a long document ended the prefix early, or the source is small), the order is
gone down further in passes: each takes, of the documents after the last pass that fit in what is left, the longest prefix
that does, until no more than NEAR is open or no document fits.

The uniform number is a hash of seed, doc_id and text: reruns agree on any cluster. No source is gathered in one task:
g comes from counts of the sizes that occur, and the end of a pass from sums over 1024 bins of the rank, then over 1024
bins within the bin of the cut, so that only documents of that last bin are sorted.

Words are ``[^\x20\x09-\x0D]+``. Defined cases: null text has size 0; a null source is a source, ordered last; equal rows
(same doc_id and text) are one unit, all taken or none; a source without words has target 0;
no rows give no rows; other columns are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, space_words, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
BINS = 1024
#: The share of a source's rest that may stay open.
NEAR = 0.005
PASSES = "array<struct<room: double, cut_fine: int, last: struct<rank: double, key: string>>>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Of rows (source, size): source, source_size, weight, target (words)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # In the order of cap / weight, a source is at its cap iff its share of what the ones before it leave is at least the cap.
    caps = by.withColumn("cap", F.col("source_size") * max_repeat)
    rank = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = rank.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    caps = caps.select(
        "*", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"), F.row_number().over(rank).alias("k"),
    )
    open_ = F.col("weight").cast("double") * F.col("left") < F.col("cap").cast("double") * F.col("left_weight")  # in doubles: the products pass 2^63 at scale
    caps = caps.withColumn("first", F.min(F.when(open_, F.struct("k", "left", "left_weight"))).over(every))
    full = F.col("first").isNull() | (F.col("k") < F.col("first.k"))
    return caps.select(
        "source", "source_size", "weight",
        F.when(full, F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("first.left")).cast("double") / F.col("first.left_weight").cast("double")).alias("target"),
    )


def _keyed(documents: DataFrame, seed: str, doc: str, text: str, source: str) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return documents.select("*", F.col(source).alias("__source"), F.size(space_words(F.col(text))).cast("long").alias("__size"), key.alias("__key"))


def inclusion(sizes: DataFrame) -> DataFrame:
    """Of rows (source, rest, size): per source the probability of inclusion for each word, `per_word`: min(1, per_word * size)
    times size adds up to rest. Sources whose documents all fit in the rest have none. Sizes above the rest do not count."""
    by = sizes.where((F.col("size") > 0) & (F.col("size") <= F.col("rest"))).groupBy("source", "rest", "size").agg(F.count("*").alias("n"))
    order = W.partitionBy("source").orderBy("size")  # over the sizes that occur, at most as many as the longest text has words
    whole = F.col("size").cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)")
    by = by.select("source", "rest", "size", whole.cast("decimal(38,0)").alias("words"), (whole.cast("decimal(28,0)") * F.col("size").cast("decimal(10,0)")).cast("decimal(38,0)").alias("squares"))
    by = by.withColumn("longer", (F.sum("words").over(W.partitionBy("source")) - F.sum("words").over(order)).cast("double")).withColumn("upto", F.sum("squares").over(order).cast("double"))
    # With all sizes above this one certain, and this one not: the largest such size, as the sum falls with it.
    open_ = by.where(F.col("longer") + F.col("upto") / F.col("size") > F.col("rest"))
    found = open_.groupBy("source", "rest").agg(F.max(F.struct("size", "longer", "upto")).alias("x"))
    return found.select("source", ((F.col("rest") - F.col("x.longer")) / F.col("x.upto")).alias("per_word"))


def _ranked(df: DataFrame) -> DataFrame:
    """Adds the Pareto rank and its bins; df has size, key, rest, per_word. Rows that can't be in the rest have no rank."""
    u = (F.conv(F.substring("key", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = F.col("per_word") * F.col("size")
    rank = F.when(p < 1, u / (F.lit(1.0) - u) / (p / (F.lit(1.0) - p))).otherwise(0.0)
    df = df.withColumn("rank", F.when((F.col("size") > 0) & (F.col("size") <= F.col("rest")), rank))
    v = F.col("rank") / (F.lit(1.0) + F.col("rank"))
    return df.withColumn("bin", F.floor(v * float(BINS)).cast("int")).withColumn("fine", F.floor(v * float(BINS * BINS)).cast("int"))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, doc: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(narrow rows of all documents: doc_id, source, size, key; per source: target, copies, rest, per_word and `passes` down its
    order (room: the size up to which it takes units; where it ends: `cut_fine` and `last` (rank, key)); `barred`: source and
    key of equal rows that fit in a pass one by one, but not together)."""
    rows = written(_keyed(documents, seed, doc, text, source).select(F.col(doc).alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key")), "mix-rows")
    goal = targets(rows, weights, max_repeat)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    few = goal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # one row per source; so are all tables that `hint` takes
    hint = F.broadcast if few else lambda df: df
    goal = written(_with(goal, inclusion(_with(rows, hint(goal.select("source", "rest")))), "left"), "mix-odds")
    units = _ranked(_with(rows, hint(goal))).where("rank is not null")
    units = written(units.groupBy("source", "key", "rank", "bin", "fine").agg(F.sum("size").alias("words"), F.max("size").alias("size")), "mix-units")

    def open_(cut: DataFrame) -> DataFrame:
        """The units of unfinished sources that are not taken and fit in what is left; those that a pass left behind are too large for good."""
        behind = F.exists("passes", lambda p: _within(p))
        return _with(units, hint(cut.where(F.col("gap") > NEAR * F.col("rest"))), "inner").where(~behind & (F.col("words") <= F.col("gap")))

    def crossing(sums: DataFrame, col: str) -> DataFrame:
        """The bin in which the sums of words pass the gap, and what the bins before it hold, per source that has one."""
        upto = F.sum("s").over(W.partitionBy("source").orderBy(col))
        sums = sums.withColumn("upto", F.col("base") + upto).where(F.col("upto") > F.col("gap"))
        return sums.groupBy("source").agg(F.min(F.struct(col, (F.col("upto") - F.col("s")).alias("base"))).alias("x")).select("source", F.col(f"x.{col}").alias(f"cut_{col}"), F.col("x.base").alias("base"))

    def down(here: DataFrame, cut: DataFrame, room) -> DataFrame | None:
        """cut after one more pass over the units `here`, of each source that has any; None if there are none."""
        sums = lambda rows, col: rows.groupBy("source", "gap", "base", col).agg(F.sum("words").alias("s"))
        bins = written(sums(here.withColumn("base", F.lit(0).cast("long")), "bin"), "mix-bins")
        if bins.isEmpty():
            return None
        whole = bins.groupBy("source").agg(F.sum("s").alias("whole"))
        coarse = crossing(bins, "bin")
        within = _with(here, hint(coarse), "inner").where("bin = cut_bin")
        fine = written(crossing(sums(within, "fine"), "fine"), "mix-cut")
        edge = _with(here, hint(fine), "inner").where("fine = cut_fine")
        total = F.sum("words").over(W.partitionBy("source").orderBy("rank", "key").rangeBetween(W.unboundedPreceding, 0))
        edge = edge.withColumn("upto", F.col("base") + total).where(F.col("upto") <= F.col("gap"))
        edge = edge.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("last"), F.max("upto").alias("used"))
        cut = _with(_with(_with(cut, hint(whole), "left"), hint(fine), "left"), hint(edge), "left")
        one = F.array(F.struct(room.alias("room"), "cut_fine", "last"))
        return written(cut.select(
            "source", "rest", (F.col("gap") - F.coalesce("used", "base", "whole", F.lit(0))).alias("gap"),
            F.when(F.col("whole").isNull(), F.col("passes")).otherwise(F.concat("passes", one)).alias("passes")), "mix-cut")

    cut = goal.select("source", "rest", F.col("rest").alias("gap"), F.array().cast(PASSES).alias("passes"))
    after, room = down(_with(units, hint(cut), "inner"), cut, F.lit(float("inf"))), F.col("gap")
    while after is not None:
        cut, after = after, down(open_(after), after, room)
    room = _room()
    barred = _with(units, hint(cut), "inner").where((F.col("size") <= room) & (F.col("words") > room)).select("source", "key")
    return rows, written(_with(goal, hint(cut.drop("gap", "rest")), "left"), "mix-plan"), written(barred, "mix-barred")


def _within(p):
    """Whether a row of columns fine, rank, key is not after the end of a pass; one that reached the end of the order has no cut."""
    return p["cut_fine"].isNull() | (F.col("fine") < p["cut_fine"]) | ((F.col("fine") == p["cut_fine"]) & F.coalesce(F.struct("rank", "key") <= p["last"], F.lit(False)))


def _room():
    """The words that were left in the pass that went by a row; null where none did."""
    return F.get(F.filter("passes", lambda p: _within(p)), F.lit(0))["room"]


def _with(rows: DataFrame, by_source: DataFrame, how: str = "left") -> DataFrame:
    """rows joined to a table of sources, null sources included."""
    again = by_source.withColumnRenamed("source", "__s")
    both = set(rows.columns) & set(again.columns)
    return rows.drop(*both).join(again, rows["source"].eqNullSafe(F.col("__s")), how).drop("__s")


def _copies(df: DataFrame, barred: DataFrame) -> DataFrame:
    """df with `n`, how often a row is taken; df is ranked and has source, key and the columns of its source's plan."""
    if barred.isEmpty():
        fits = F.col("size") <= _room()
    else:
        barred = small(barred.withColumnRenamed("source", "__s").withColumnRenamed("key", "__k").withColumn("__barred", F.lit(True)))
        df = df.join(barred, F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k")), "left")
        fits = (F.col("size") <= _room()) & F.col("__barred").isNull()
    drawn = F.col("rank").isNotNull() & F.coalesce(fits, F.lit(False))
    return df.withColumn("n", F.coalesce(F.col("copies"), F.lit(0)) + drawn.cast("long"))


def takes(documents: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, copies, taken (words)."""
    rows, by, barred = plan(documents, **options)
    out = _copies(_ranked(_with(rows, small(by))), barred)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("n").alias("copies"), (F.col("size") * F.col("n")).alias("taken"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """documents as the mix takes them: each row as often as it is taken, with `copy` (from 1; in place of such a column) added. Texts are shuffled only where
    more rows than a broadcast takes are barred."""
    _, by, barred = plan(documents, weights, max_repeat, seed, doc, text, source)
    by = small(by.select([F.col(c).alias(f"__by_{c}") for c in by.columns]))
    joined = _keyed(documents, seed, doc, text, source).join(by, F.col("__source").eqNullSafe(F.col("__by_source")), "left")
    own = [F.struct("*").alias("row"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key")]
    out = _ranked(joined.select(*own, *[F.col(f"__by_{c}").alias(c) for c in ("copies", "rest", "per_word", "passes")]))
    out = _copies(out, barred).select("row", "n").where("n > 0")
    return out.select(*[F.col("row")[c].alias(c) for c in documents.columns if c != "copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
