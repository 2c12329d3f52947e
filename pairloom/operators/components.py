"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.plans.lineage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges; nodes without an edge to another are left out.

    Null ends and self-loops are ignored, repeated edges count once. Every round is two aggregations and two joins on
    rows of two values, written to the shared folder; only a count and a checksum of what was written come to the driver, with the writing.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    now = scratch.keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        written = Observation()
        after = scratch.keep(_small_star(_large_star(now)).observe(written, F.count("*").alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")))
        mark = written.get
        scratch.drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
