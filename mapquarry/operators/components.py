"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import checkpoint


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return edges.join(low, "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
    return moved.union(low.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b)."""
    now = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        now = checkpoint(_small(_large(now).distinct()).distinct())
        # done when each node has one parent, and no parent has one itself
        ends = now.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("a", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if open_.isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
