"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round is two joins on node ids whose hubs Spark can split, and its edges are written to
the shared folder, so lineage stays short and a lost executor costs one round at most. Only
two sums a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    near = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(low, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that can be reached) for every node of the edges (u, v);
    edges from a node to itself are ignored, as are null ones, and repeated ones count once."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    now = materialize(now, "edges")
    seen = _sum(now)
    while seen[0]:
        old, now = now, materialize(_star(_star(now, True), False), "edges")
        drop(old)
        if (new := _sum(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
