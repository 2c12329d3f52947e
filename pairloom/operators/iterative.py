"""Iterative node metrics; every few rounds a table in the shared folder cuts the lineage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.graph import adjacency, component_table, degrees
from pairloom.plans.lineage import Scratch

EVERY = 5
#: Rounds after which core numbers look for trees.
TREES = 12


def _iterate(start: DataFrame, step, rounds: int, label: str, value: str, tolerance: float | None = None) -> DataFrame:
    """The state after so many rounds; with a tolerance, after the first EVERY rounds of which the last changes the values of the nodes by less than that on
    average, and an error if no round does."""
    scratch = Scratch(start.sparkSession, label)
    now = scratch.keep(start)
    for i in range(1, rounds + 1):
        after = step(now)
        if i % EVERY == 0 and i < rounds or tolerance is not None and i == rounds:
            after = scratch.keep(after)
            if tolerance is not None:
                last = scratch.keep(step(after))
                moved = last.withColumnRenamed(value, "_new").join(after, "node").agg(F.avg(F.abs(F.col("_new") - F.col(value)))).first()[0]
                if (moved or 0.0) < tolerance:
                    return last
        now = after
    if tolerance is not None:
        raise RuntimeError(f"{label} did not settle in {rounds} rounds")
    return now


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """node, rank from the uniform start; ranks sum to 1. After a fixed number of rounds, or, with a tolerance, once the ranks change by less on average (an
    error if that takes more rounds)."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    adj = adjacency(edges)
    n = adj.select("src").distinct().count()
    out = scratch.keep(adj.join(degrees(adj).select(F.col("node").alias("src"), "d_nb"), "src"))
    start = out.select(F.col("src").alias("node")).distinct().select("node", F.lit(1.0 / max(n, 1)).alias("rank"))

    def step(ranks: DataFrame) -> DataFrame:
        sent = out.join(ranks.withColumnRenamed("node", "src"), "src")
        return sent.groupBy(F.col("dst").alias("node")).agg((F.lit((1 - alpha) / max(n, 1)) + alpha * F.sum(F.col("rank") / F.col("d_nb"))).alias("rank"))

    return _iterate(start, step, rounds, "pagerank", "rank", tolerance)


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (ties to the smallest id)."""
    comp = component_table(edges)
    top = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = comp.join(top, "component", "left_semi").select(F.col("node").alias("u"))
    return edges.join(inside, "u", "left_semi")


def katz(edges: DataFrame, rounds: int = 20, share: float = 0.9, beta: float = 1.0, tolerance: float | None = None) -> DataFrame:
    """node, katz on the largest component, alpha = share / largest degree, of Euclidean length 1. Rounds and tolerance are those of pagerank."""
    scratch = Scratch(edges.sparkSession, "katz")
    adj = scratch.keep(adjacency(largest_component(edges)))
    alpha = share / max(1, degrees(adj).agg(F.max("d")).first()[0] or 0)
    start = adj.select(F.col("src").alias("node")).distinct().select("node", F.lit(0.0).alias("x"))

    def step(x: DataFrame) -> DataFrame:
        return adj.join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((alpha * F.sum("x") + F.lit(beta)).alias("x"))

    x = scratch.keep(_iterate(start, step, rounds, "katz", "x", tolerance))
    length = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    return x.select("node", (F.col("x") / F.lit(length or 1.0)).alias("katz"))


def _with_trees_settled(now: DataFrame, adj: DataFrame) -> DataFrame:
    """The values with 1 on every component that is a tree, which long chains would take a round for each node from their ends to reach."""
    comp = component_table(adj.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    ends = adj.join(comp.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("ends"))
    trees = comp.groupBy("component").agg(F.count("*").alias("n")).join(ends, "component").where("ends = 2 * (n - 1)").select("component")
    in_trees = comp.join(trees, "component", "left_semi").select("node", F.lit(1).cast("long").alias("one"))
    return now.join(in_trees, "node", "left").select("node", F.coalesce("one", "core").alias("core"))


def core_numbers(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, core: the h-index of the neighbours' values, from the degrees down to the fixpoint (Lu et al., 2016). Self-loops are left out.

    It runs until nothing changes; where max_rounds is given and doesn't suffice, it raises. Values only fall, so it ends.
    A tail that hangs from a denser part takes a round for each of its nodes; components that are trees are settled at once after TREES rounds.
    """
    scratch = Scratch(edges.sparkSession, "cores")
    adj = scratch.keep(adjacency(edges.where("u <> v")))
    now = scratch.keep(degrees(adj).select("node", F.col("d").alias("core")))
    mark = None
    for i in count() if max_rounds is None else range(max_rounds):
        if i == TREES:
            before, now = now, scratch.keep(_with_trees_settled(now, adj))
            scratch.drop(before)
            mark = None
        near = adj.join(now.select(F.col("node").alias("dst"), "core"), "dst").groupBy("src", "core").agg(F.count("*").alias("n"))
        falling = F.sum("n").over(_by_falling_core())
        h = near.withColumn("h", F.least("core", falling)).groupBy(F.col("src").alias("node")).agg(F.max("h").alias("core"))
        after = scratch.keep(h)
        total = after.agg(F.sum("core")).first()[0]
        scratch.drop(now)
        now = after
        if total == mark:
            break
        mark = total
    else:
        raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")
    return now


def _by_falling_core():
    from pyspark.sql import Window

    return Window.partitionBy("src").orderBy(F.desc("core"))
