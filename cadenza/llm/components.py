"""Connected components of an edge table by repeated contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges (a, b): comp is one node of the component, the same for all its nodes.

    Each round orders the nodes at random (by a hash of the round's number), gives every node the first of itself and its
    neighbours, and then that one's first, and replaces both ends of every edge by these; edges within one label go. As the
    order is random, a round leaves about a third of the nodes whatever the ids are, so a path takes a number of rounds that
    grows with its logarithm. Each round is written to the shared folder. Null ends are dropped; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = written(edges, "cc-edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    found, k = ends.withColumn("comp", F.col("node")), 0
    while not edges.isEmpty():
        place = lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("h"), F.col(x).alias("node"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.least(place("a"), F.min(place("b")))["node"].alias("next"))
        first = written(first, "cc-first")
        least = written(first.join(first.select(F.col("a").alias("next"), F.col("next").alias("to")), "next").select("a", "to"), "cc-labels")
        found = found.join(least.select(F.col("a").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        found = written(found, "cc-found")
        edges = edges.join(least.select("a", F.col("to").alias("x")), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges, k = written(edges, "cc-edges"), k + 1
    return found
