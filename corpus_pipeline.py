"""The corpus pipeline: documents through four stages, each reading what the one before it kept.

Null and empty texts fail the quality rules and go in the first stage, whatever their other columns hold; nulls in other columns (doc_id and lang too) and columns
of any other name pass through. Repeated rows are copies: near duplicates keep one. Very long texts pass every stage whole. An empty table
passes every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.jaccard_join import keep_one_of_each
from pairloom.llm.packing import pack_documents
from pairloom.llm.pii import pseudonymise
from pairloom.llm.quality import keep_good, labelled_references
from pairloom.llm.queries import pseudonym_key
from pairloom.plans.lineage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the rules' references are measured on documents labelled good."""
    return keep_good(docs, labelled_references(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect (five-word shingles, similarity 0.8 or more) the one with the smallest doc_id stays. Every row is a document of its own."""
    return keep_one_of_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to pseudonyms; n_chars follows the text."""
    return pseudonymise(docs, pseudonym_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packing)]

#: Shingles, histograms and tokens are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed once the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return docs
