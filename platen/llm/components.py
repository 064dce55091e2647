"""Connected components by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star: link a node's greater neighbours to the least of it and its neighbours. Small-star: link its smaller neighbours and itself to the least."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    return nodes.where("above > 1 or above > 0 and below > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, unequal). node, component: the smallest node of each component, for every node that has an edge."""
    now = common.kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    while not _settled(now):
        new = common.kept(_star(_star(now, True), False), "edges")
        common.drop_kept(now)
        now = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
