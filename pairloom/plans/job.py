"""Queries as a job: spark-submit -m pairloom.plans.job --tables DIR --out DIR --queries a,b [--format parquet]."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession

from pairloom.plans import registry


def listed(kind: Callable = str) -> Callable[[str], list]:
    """A parser of comma-separated values."""
    return lambda text: [kind(x.strip()) for x in text.split(",") if x.strip()]


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Runs queries over a folder of Parquet tables and writes each result to a folder of its name.")
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--out", required=True, help="folder of the results")
    p.add_argument("--queries", type=listed(), required=True, help="names, parted by commas")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json", "orc"])
    known, names = registry.queries(), p.parse_args(arguments)
    if unknown := [x for x in names.queries if x not in known]:
        p.error(f"no such query: {', '.join(unknown)}")
    return names


def main(arguments: list[str] | None = None) -> None:
    asked = parse(arguments)
    spark = SparkSession.builder.getOrCreate()
    for name in asked.queries:
        registry.queries()[name](spark, asked.tables).write.mode("overwrite").format(asked.format).option("header", True).save(f"{asked.out}/{name}")


if __name__ == "__main__":
    main()
