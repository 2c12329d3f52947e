"""The pair tables and named queries as views of the session, beside the library's SQL functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from pairloom.functions import session
from pairloom.plans import fixtures, registry

TABLES = {"text_pairs": fixtures.text_pairs, "graph_pairs": fixtures.graph_pairs, "vector_pairs": fixtures.vector_pairs, "label_rows": fixtures.label_rows}


def create(spark: SparkSession, folder: str, names: Iterable[str] = ()) -> list[str]:
    """Views of the pair tables made from a folder of Parquet tables, and of the named queries over it; what they are called. The functions are registered too.

    A view is a plan, not a copy; queries with several rounds make their intermediate tables now."""
    session.register(spark)
    known = registry.queries()
    made = TABLES | {name: known[name] for name in names}
    for name, make in made.items():
        make(spark, folder).createOrReplaceTempView(name)
    return list(made)
