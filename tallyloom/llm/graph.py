"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tasks


def _round(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One round over edges (u > v), in ``parts`` tasks between shuffles: neighbours move to the smallest of their neighbourhood."""
    edges = edges.coalesce(parts)
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(parts).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node that has an edge.

    Self-loops and repeated edges are harmless; nodes without edges aren't returned.
    Minima are combined before the shuffle; each round is cut, and rounds grow with
    the logarithm of the longest path.
    """
    edges = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    parts = tasks(2 * edges.count())
    while True:
        edges = cut(_round(_round(edges, True, parts), False, parts).coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
