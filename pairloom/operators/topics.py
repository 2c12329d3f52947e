"""Topic mixtures and latent vectors of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.sums import sums
from pairloom.functions.text import tokens, word_tokens
from pairloom.functions.vectors import topic_pair
from pairloom.operators import mixtures
from pairloom.operators.tfidf import fit
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship


@dataclass(frozen=True)
class TopicModel:
    """What turns `words` into `counts` of the vocabulary's terms, the topics' weights by term, and the concentration of mixtures."""

    words: PipelineModel
    weights: np.ndarray
    alpha: np.ndarray
    seed: int

    def counts(self, pairs: DataFrame, column: str) -> DataFrame:
        made = self.words.transform(pairs.withColumn("words", word_tokens(F.col(column))))
        return made.drop("words", "kept", column).withColumnRenamed("counts", column)


def _held(pairs: DataFrame) -> DataFrame:
    """copies, kept: each text of the pairs once, with the number of times that it occurs, and its words without stop words."""
    texts = pairs.select(F.explode(F.array("question1", "question2")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return StopWordsRemover(inputCol="words", outputCol="kept").transform(texts.select("copies", word_tokens(F.col("text")).alias("words"))).drop("words")


def _terms_of(held: DataFrame, least: int, share: float, size: int) -> list[str]:
    """The most frequent words, `size` at most, of those that `least` texts hold and no more than the share of all; copies count."""
    one, none = F.col("copies"), F.lit(0)
    seen = F.concat(F.transform("kept", lambda w: F.struct(w.alias("term"), one.alias("tf"), none.cast("long").alias("df"))), F.transform(F.array_distinct("kept"), lambda w: F.struct(w.alias("term"), none.cast("long").alias("tf"), one.alias("df"))))
    most = share * (held.agg(F.sum("copies")).first()[0] or 0)
    counts = held.select(F.explode(seen).alias("x")).groupBy("x.term").agg(F.sum("x.tf").alias("tf"), F.sum("x.df").alias("df"))
    return [r.term for r in counts.where((F.col("df") >= least) & (F.col("df") <= most)).orderBy(F.desc("tf"), "term").limit(size).select("term").collect()]


def topic_model(pairs: DataFrame, topics: int = 10, size: int = 20_000, rounds: int = 10, seed: int = 951) -> TopicModel:
    """Topics fitted on both texts of the pairs. Equal texts are inferred once and count as often as they occur."""
    scratch = Scratch(pairs.sparkSession, "topics")
    held = scratch.keep(_held(pairs))
    terms = _terms_of(held, 2, 0.95, size)
    # no word is empty, so without terms all texts are
    counts = CountVectorizerModel.from_vocabulary(terms or [""], "kept", "counts")
    texts = scratch.keep(counts.transform(held).select("copies", "counts"))
    scratch.drop(held)
    weights, alpha = mixtures.fit(texts, max(1, len(terms)), topics, rounds, seed)
    scratch.drop(texts)
    return TopicModel(PipelineModel([StopWordsRemover(inputCol="words", outputCol="kept"), counts]), weights, alpha, seed)


def topic_pairs(model: TopicModel, pairs: DataFrame) -> DataFrame:
    """id and the pair features of the two texts' topic mixtures."""
    sides = ["question1", "question2"]
    counted = reduce(model.counts, sides, pairs.select("id", *sides))
    both = mixtures.shares(counted, sides, model.weights, model.alpha, model.seed)
    return both.select("id", *(c.alias(n) for n, c in topic_pair(F.col("question1"), F.col("question2"), len(model.alpha)).items()))


def topic_features(pairs: DataFrame, **options) -> DataFrame:
    """id and the pair features of topics fitted on all texts of the table."""
    return topic_pairs(topic_model(pairs, **options), pairs)


def common_words(pairs: DataFrame) -> DataFrame:
    """Pairs with `words`, those that both texts hold, once each, in place of the texts; latent models take such rows too, so folds need not take texts apart again."""
    return pairs.withColumn("words", F.array_intersect(tokens(F.col("question1")), tokens(F.col("question2")))).drop("question1", "question2")


def _common(pairs: DataFrame) -> DataFrame:
    """id, words."""
    return (pairs if "words" in pairs.columns else common_words(pairs)).select("id", "words")


def _weighed(terms: pa.Array, idf: np.ndarray, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, place and weight of the words that are terms: idf, of length 1 in a row."""
    place = pc.index_in(words.flatten(), value_set=terms)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), pc.fill_null(words.value_lengths(), 0).to_numpy())[known]
    idx = place.drop_null().to_numpy()
    return row, idx, idf[idx] / np.sqrt(np.bincount(row, idf[idx] ** 2, len(words)))[row]


def _weighted_rows(pairs: DataFrame, terms: list[str], idf: list[float]) -> DataFrame:
    """idx array<int>, w array<double>: the TF-IDF rows of pairs with a term. Tasks hold the vocabulary, so no word is shuffled."""
    sent = pairs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = pa.array(sent.value[0], pa.string()), np.array(sent.value[1])
        for batch in batches:
            row, idx, w = _weighed(held, weight, batch.column(0))
            ends = np.concatenate(([0], np.cumsum(np.unique(row, return_counts=True)[1]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))], names=["idx", "w"])

    return ship(_common(pairs).select("words")).mapInArrow(run, "idx array<int>, w array<double>")


def _add_rows(out: np.ndarray, idx: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values to the row of out that idx names."""
    if len(idx):
        if (idx[1:] < idx[:-1]).any():
            order = np.argsort(idx, kind="stable")
            idx, values = idx[order], values[order]
        own, first = np.unique(idx, return_index=True)
        out[own] += np.add.reduceat(values, first)


def _gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A times a basis, for sparse rows (idx array<int>, w array<double>) of A: one pass over the rows. Tasks hold a table as large as the basis."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        b = sent.value
        out = np.zeros_like(b)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                idx, w = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy())
                product = np.zeros((batch.num_rows, b.shape[1]))
                _add_rows(product, row, w[:, None] * b[idx])
                _add_rows(out, idx, w[:, None] * product[row])
        yield out

    out = sums(rows, run, basis.shape)
    sent.destroy()
    return out


def right_singular_vectors(rows: DataFrame, n: int, k: int, rounds: int = 5, spare: int = 10, seed: int = 951) -> np.ndarray:
    """The first k right singular vectors (columns) of sparse rows over n places, by randomised subspace iteration (Halko, Martinsson and Tropp, 2011): rounds + 2 passes over the rows.

    The driver and each task hold n times (k + spare) numbers, so n has to be bounded."""
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, k + spare))))[0]
    for _ in range(rounds + 1):
        basis = np.linalg.qr(_gram_times(rows, basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ _gram_times(rows, basis))
    return basis @ vectors[:, np.argsort(-values)[:k]]


def latent_model(pairs: DataFrame, k: int = 64, min_df: int = 3, max_df: float = 0.95, size: int = 120_000) -> DataFrame:
    """term, idf, v: the vocabulary of the pairs' common words and its loadings on the first k right singular vectors of the TF-IDF rows, largest loading positive.

    `size` terms at most come to the driver, with k loadings each, as arrays; the result is a written table, so no plan holds them."""
    session = pairs.sparkSession
    words = _common(pairs)
    vocab = fit(words.select(F.explode("words").alias("term"), F.lit(1).alias("tf")), pairs.count(), min_df, max_df, size).select("term", "idf").orderBy("term").collect()
    if not vocab:
        return session.createDataFrame([], "term string, idf double, v array<double>")
    terms, idf = [r.term for r in vocab], [r.idf for r in vocab]
    rows = Scratch(session, "latent").keep(_weighted_rows(words, terms, idf))
    v = right_singular_vectors(rows, len(vocab), min(k, len(vocab)))
    v = v * [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in v.T]
    loadings = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
    table = pa.table({"term": terms, "idf": pa.array(idf, pa.float64()), "v": loadings})
    return Scratch(session, "latent").keep(session.createDataFrame(table))


def latent_rows(model: DataFrame, pairs: DataFrame, k: int = 64) -> DataFrame:
    """id, svd array<double>: the common words' TF-IDF projected on the model's loadings; zeros without any. Tasks hold the loadings, so nothing is shuffled."""
    table = model.select("term", "idf", "v").toArrow().combine_chunks()
    v = np.zeros((table.num_rows, k))
    if table.num_rows:
        found = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        v[:, : found.shape[1]] = found[:, :k]
    sent = model.sparkSession.sparkContext.broadcast((table["term"].to_pylist(), table["idf"].to_pylist(), v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = pa.array(sent.value[0], pa.string()), np.array(sent.value[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                row, idx, w = _weighed(terms, idf, batch.column(1))
                out = np.zeros((batch.num_rows, k))
                _add_rows(out, row, w[:, None] * sent.value[2][idx])
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["id", "svd"])

    words = _common(pairs)
    return ship(words).mapInArrow(run, f"id {words.schema['id'].dataType.simpleString()}, svd array<double>")


def latent_features(pairs: DataFrame, k: int = 64, **bounds) -> DataFrame:
    """id, svd array<double> under the loadings of all pairs."""
    pairs = Scratch(pairs.sparkSession, "latent").keep(common_words(pairs))
    return latent_rows(latent_model(pairs, k, **bounds), pairs, k)
