"""Pair tables made from the driver's tables, whole tables each, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation: id, question1, question2, is_duplicate (whether an assistant answers)."""
    said = _table(spark, sf_dir, "conversations")
    a, b = said.alias("a"), said.alias("b")
    on = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)
    return a.join(b, on).select((F.col("a.conv_id") * 1_000_000 + F.col("a.turn")).alias("id"), F.col("a.text").alias("question1"), F.col("b.text").alias("question2"), (F.col("b.role") == "assistant").cast("int").alias("is_duplicate"))


def split_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pairs as training and test pairs, the latter (a quarter, by a hash of the id) without their label."""
    pairs = text_pairs(spark, sf_dir)
    tested = F.substring(F.md5(F.col("id").cast("string")), 1, 1).isin("0", "1", "2", "3")
    return pairs.where(~tested), pairs.where(tested).drop("is_duplicate")


def weighted_graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that an order holds in equal quantity: u <= v, weight (the lower discount)."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_discount")
    a, b = lines.alias("a"), lines.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_quantity") == F.col("b.l_quantity")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    pair = F.col("a.l_partkey"), F.col("b.l_partkey")
    weight = F.least("a.l_discount", "b.l_discount").cast("double").alias("weight")
    return a.join(b, on).select(F.least(*pair).cast("long").alias("u"), F.greatest(*pair).cast("long").alias("v"), weight)


def graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that an order holds in equal quantity: u <= v, distinct."""
    return weighted_graph_pairs(spark, sf_dir).select("u", "v").distinct()


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring embeddings: id, a, b (arrays of double), is_duplicate (equal labels)."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("id"), F.col("a.e").alias("a"), F.col("b.e").alias("b"), (F.col("a.label") == F.col("b.label")).cast("int").alias("is_duplicate"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("is_duplicate"))


TEXT_SQL = """text_pairs as (select a.conv_id * 1000000 + a.turn as id, a.text as question1, b.text as question2,
    case when b.role = 'assistant' then 1 else 0 end as is_duplicate
    from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""
SPLIT_SQL = TEXT_SQL + """, train as (select * from text_pairs where left(md5(cast(id as varchar)), 1) not in ('0', '1', '2', '3')),
    test as (select * from text_pairs where left(md5(cast(id as varchar)), 1) in ('0', '1', '2', '3'))"""
_ADJACENT = """adj as (select u as src, v as dst from graph_pairs union select v, u from graph_pairs),
  nb as (select src as node, count(*) as d_nb, count(*) + sum(case when src = dst then 1 else 0 end) as d from adj group by src)"""
GRAPH_SQL = """graph_pairs as (select distinct least(a.l_partkey, b.l_partkey) as u, greatest(a.l_partkey, b.l_partkey) as v
    from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_quantity = b.l_quantity and a.l_linenumber < b.l_linenumber),
  """ + _ADJACENT
VECTOR_SQL = """vector_pairs as (select a.vec_id as id, cast(a.embedding as double[]) as a, cast(b.embedding as double[]) as b,
    case when a.label = b.label then 1 else 0 end as is_duplicate from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"""
_HASHED = "md5(trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g')))"
#: The graph of texts, numbered in order of their hashes; ends says which nodes a pair's texts are.
TEXT_GRAPH_SQL = f"""{TEXT_SQL}, hashed as (select id, {_HASHED.format("question1")} as h1, {_HASHED.format("question2")} as h2 from text_pairs),
    names as (select h, row_number() over (order by h) as node from (select h1 as h from hashed union select h2 from hashed)),
    ends as (select id, least(a.node, b.node) as u, greatest(a.node, b.node) as v from hashed join names a on a.h = h1 join names b on b.h = h2),
    graph_pairs as (select distinct u, v from ends), {_ADJACENT}"""
