"""Row numbers within groups of any size, without a task for each group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.plans.lineage import Scratch


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`, the row number (from 1) in the groups of the columns `by` (nulls are a group), in the given order.

    Rows are dealt by ranges of group and order, so a group is as many tasks as it needs, and are written so that
    numbers and counts see one dealing. A row's number is its place in its range and the rows of its group in the ranges before, which
    are a broadcast of about as many rows as there are ranges and groups.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = scratch.keep(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: f"_group{i}" for i, c in enumerate(["_range", *by])}
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnsRenamed(renamed)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(g)) for c, g in renamed.items()))
    return dealt.join(F.broadcast(starts), same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
