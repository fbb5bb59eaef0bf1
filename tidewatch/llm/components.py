"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``edges`` (a, b: long).

    Each step only re-hangs edges on smaller nodes, so their number does not grow; the
    steps are repeated until nothing changes, a number of times that grows with the
    logarithm of the nodes.  Each step is checkpointed.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _print_of(now)
    while True:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a")
        now = cut(hung.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.toDF("a", "b")).distinct())
        if (then := _print_of(now)) == mark:
            break
        mark = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
