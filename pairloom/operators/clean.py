"""Cleaning of pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import common, dice, different, jaccard_distance, stable_hash, tokens


def drop_null_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.na.drop(subset=["question1", "question2"])


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_rank")
    return rows.select("*", rank).where("_rank = 1").drop("_rank")


def clean_pairs(pairs: DataFrame, id_column: str = "id") -> DataFrame:
    """Ids as long (rows whose id is no number go), one row per id, no null texts."""
    cast = pairs.withColumn(id_column, F.expr(f"try_cast({id_column} as long)")).where(F.col(id_column).isNotNull())
    return first_of_each(drop_null_pairs(cast), id_column, ["question1", "question2"])


def hash_pairs(pairs: DataFrame, *keep: str) -> DataFrame:
    return pairs.select("id", stable_hash(F.col("question1")).alias("h1"), stable_hash(F.col("question2")).alias("h2"), *keep)


def token_similarity(pairs: DataFrame) -> DataFrame:
    t = pairs.select("id", tokens(F.col("question1")).alias("a"), tokens(F.col("question2")).alias("b"))
    return t.select("id", jaccard_distance(F.col("a"), F.col("b")).alias("jaccard_distance"), dice(F.col("a"), F.col("b")).alias("dice"))


def word_differences(pairs: DataFrame) -> DataFrame:
    a, b = tokens(F.col("question1")), tokens(F.col("question2"))
    return pairs.select("id", F.array_join(common(a, b), " ").alias("common_words"), F.array_join(different(a, b), " ").alias("diff_words"))
