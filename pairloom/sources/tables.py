"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN = "id string, question1 string, question2 string, is_duplicate int"
TEST = "test_id string, question1 string, question2 string"
#: Strings that stand for a missing value (fixed values).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_pairs(spark: SparkSession, path: str, schema: str = TRAIN, texts: tuple[str, ...] = ("question1", "question2")) -> DataFrame:
    """A CSV of pairs with quoted, multi-line texts and doubled quotes; missing-value strings become null in the named columns, ids become long."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    key = rows.columns[0]
    cleaned = {c: F.when(F.col(c).isin(MISSING), None).otherwise(F.col(c)) for c in texts}
    return rows.withColumns(cleaned).withColumn(key, F.expr(f"coalesce(try_cast({key} as long), try_cast(try_cast({key} as decimal(38, 6)) as long))"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, vec from a text file of a word and its numbers, parted by single spaces."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(F.element_at(parts, 1).alias("token"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, idx from files of a JSON object of numbers, or of one on each line."""
    whole = spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", r"(?<=\})\s*\n(?=\{)")).alias("value"))
    rows = whole.select(F.from_json("value", "map<string,long>").alias("m"))
    return rows.select(F.explode("m").alias("token", "idx"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """The vocabulary as JSON objects {token: idx}, a bounded number of tokens on each line, so no task holds all of it; `read_vocabulary` reads them."""
    lines = vocab.groupBy(F.floor(F.col("idx") / 1000).alias("line")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "idx"))))).alias("value"))
    lines.select("value").write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str, *partitions: str) -> None:
    features.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_folds(spark: SparkSession, path: str, target: str, key: str = "id") -> None:
    """Features that `write_features` wrote by fold, averaged over the folds of an id and written in order of id; the parts are removed once that is done."""
    from pairloom.operators.stacking import fold_mean

    fold_mean(spark.read.parquet(path), key).orderBy(key).write.mode("overwrite").parquet(target)
    parts = spark._jvm.org.apache.hadoop.fs.Path(path)
    parts.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parts, True)


def write_submission(rows: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
