"""Latent Dirichlet allocation: MLlib's online updates (Hoffman, Blei and Bach, 2010) over all texts in each round, with the inference of many texts at once.

MLlib's inference is a fixed-point iteration of one text at a time, which near equal topics need hundreds of steps for. Here batches of texts take the same steps as products of
arrays, and after the first ones every third point is extrapolated (SQUAREM; Varadhan and Roland, 2008). A text is settled where MLlib's is: once a plain step moves it by
less than TOLERANCE a topic. Each round counts every text once, where MLlib draws as many with replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.functions.sums import sums
from pairloom.plans.ship import ship

#: MLlib's rates and tolerance, and the shape of the gamma distribution that it starts from.
OFFSET, DECAY, TOLERANCE, SHAPE = 1024.0, 0.51, 1e-3, 100.0
#: Places of texts (a text times the longest text's terms) that are inferred at once, and texts whose terms are summed at once.
PLACES, TEXTS = 16_384, 2_048
#: Terms whose sums are sent as one row.
BLOCK = 256
#: Steps of a text's first pass over two, which are plain; each pass has twice as many as the one before, and from the pass PLAIN on (500 of them) all are plain again.
STEPS, PLAIN = 8, 6


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x + 6, and how much the digamma function of x is below the logarithm of that: the terms of six steps up, then the series there."""
    z, y = x * (x + 5), x + 6
    q = 1 / (y * y)
    return y, (2 * x + 5) * ((3 * z + 20) * z + 24) / (z * (z + 4) * (z + 6)) + 0.5 / y + q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240)))


def digamma(x: np.ndarray) -> np.ndarray:
    y, below = _shifted(x)
    return np.log(y) - below


def exp_digamma(x: np.ndarray) -> np.ndarray:
    y, below = _shifted(x)
    return y * np.exp(-below)


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    q = 1 / (y * y)
    return 1 / y + 0.5 * q + q / y * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30))) + sum(1 / (x + i) ** 2 for i in range(6))


def _settle(beta: np.ndarray, counts: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, steps: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gamma after so many times two steps at most, and which rows are not settled yet. beta: (texts, topics, places)."""

    def step(x: np.ndarray) -> np.ndarray:
        theta = exp_digamma(x)
        return theta * (beta @ (counts / ((theta[:, None] @ beta)[:, 0] + 1e-100))[:, :, None])[:, :, 0] + alpha

    out, live = gamma.copy(), np.arange(len(gamma))
    moving = np.ones(len(gamma), bool)
    for _ in range(steps):
        one = step(gamma)
        out[live] = two = step(one)
        moving = np.abs(two - one).mean(1) > TOLERANCE
        if not moving.any():
            break
        if plain:
            gamma = two
        else:
            first = np.log(one / gamma)
            bend = np.log(two / one) - first
            far = np.sqrt((first * first).sum(1) / np.maximum((bend * bend).sum(1), 1e-30))[:, None]
            ahead = np.maximum(gamma * np.exp(np.clip(far * (far * bend + 2 * first), -30, 30)), alpha)
            gamma = np.where(far > 1, ahead * (two.sum(1) / ahead.sum(1))[:, None], two)
        if moving.mean() < 0.75:
            beta, counts, gamma, live, moving = beta[moving], counts[moving], gamma[moving], live[moving], moving[moving]
    return out, live[moving]


def inferred(terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row of gamma for each text; texts are given by their lengths, one after the other. beta: a row for each term and one of zeros."""
    terms, counts = np.append(terms, len(beta) - 1), np.append(counts, 0.0)
    starts = np.cumsum(lengths) - lengths
    gamma = np.tile(start, (len(lengths), 1))
    live, steps, passes = np.flatnonzero(lengths), STEPS, 0
    while len(live):
        live = live[np.argsort(lengths[live], kind="stable")]
        left, at = [], 0
        while at < len(live):
            some = lengths[live[at : at + PLACES]].astype(np.int64)
            part = live[at : at + max(1, np.searchsorted(some * np.arange(1, len(some) + 1), PLACES, "right"))]
            at += len(part)
            offset = np.arange(lengths[part[-1]])
            place = np.where(offset < lengths[part][:, None], starts[part][:, None] + offset, len(terms) - 1)
            rows = np.ascontiguousarray(beta[terms[place]].swapaxes(1, 2))
            gamma[part], rest = _settle(rows, counts[place], alpha, gamma[part], steps, passes == 0 or passes >= PLAIN)
            left.append(part[rest])
        live, steps, passes = np.concatenate(left), 2 * steps, passes + 1
    return gamma


def _texts(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, counts and lengths of sparse vectors, as MLlib lays them out."""
    _, _, indices, values = column.flatten()
    return indices.flatten().to_numpy(), values.flatten().to_numpy(), indices.value_lengths().to_numpy()


def _expected(weights: np.ndarray) -> np.ndarray:
    """The geometric means of the topics' shares by term, and a row of zeros."""
    return np.vstack([np.exp(digamma(weights) - digamma(weights.sum(0))), np.zeros(weights.shape[1])])


def _start(topics: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).gamma(SHAPE, 1 / SHAPE, topics)


def _round(texts: DataFrame, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row for each term: how often topics gave it. Two more rows: the sums over texts of the logarithms' means, and the number of texts with a term."""
    sent = texts.sparkSession.sparkContext.broadcast((beta, alpha, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        beta, alpha, start = sent.value
        out = np.zeros((len(beta) + 1, beta.shape[1]))
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                terms, counts, lengths = _texts(batch.column(1))
                copies = batch.column(0).to_numpy() * (lengths > 0)
                gamma = inferred(terms, counts, lengths, beta, alpha, start)
                met = exp_digamma(gamma)[np.repeat(np.arange(len(lengths)), lengths)] * beta[terms]
                met *= (counts * np.repeat(copies, lengths) / (met.sum(1) + 1e-100))[:, None]
                for topic in range(beta.shape[1]):
                    out[:-2, topic] += np.bincount(terms, met[:, topic], len(beta) - 1)
                out[-2] += copies @ (digamma(gamma) - digamma(gamma.sum(1))[:, None])
                out[-1] += copies.sum()
        yield out

    out = sums(ship(texts.select("copies", "counts")), run, (len(beta) + 1, beta.shape[1]), BLOCK)
    sent.destroy()
    return out


def _moved(alpha: np.ndarray, means: np.ndarray, texts: float, rate: float) -> np.ndarray:
    """Alpha after a Newton step of that rate towards the texts' likeliest one; alpha itself where that would leave the positive numbers."""
    slope = texts * (means + digamma(alpha.sum()) - digamma(alpha))
    c, q = texts * trigamma(alpha.sum()), -texts * trigamma(alpha)
    b = (slope / q).sum() / (1 / c + (1 / q).sum())
    after = alpha - rate * (slope - b) / q
    return after if (after > 0).all() else alpha


def fit(texts: DataFrame, terms: int, topics: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (terms, topics) and alpha for a written table of texts: copies, counts (a sparse vector). Driver and tasks hold a few tables as large as the weights, so terms has to be bounded."""
    weights = np.random.default_rng(seed).gamma(SHAPE, 1 / SHAPE, (terms, topics))
    alpha = np.full(topics, 1 / topics)
    for i in range(1, rounds + 1):
        rate = (OFFSET + i) ** -DECAY
        found = _round(texts, _expected(weights), alpha, _start(topics, seed + i))
        count = found[-1, 0]
        if not count:
            break
        weights = (1 - rate) * weights + rate * (found[:-2] + 1 / topics)
        alpha = _moved(alpha, found[-2] / count, count, rate)
    return weights, alpha


def shares(rows: DataFrame, columns: list[str], weights: np.ndarray, alpha: np.ndarray, seed: int) -> DataFrame:
    """The rows with each of the columns' sparse vectors replaced by the text's mixture of topics, zeros without a term."""
    sent = rows.sparkSession.sparkContext.broadcast((_expected(weights), alpha, _start(len(alpha), seed)))
    kept = [f for f in rows.schema.fields if f.name not in columns]

    def mixture(column: pa.StructArray) -> pa.Array:
        terms, counts, lengths = _texts(column)
        gamma = inferred(terms, counts, lengths, *sent.value)
        p = gamma / gamma.sum(1, keepdims=True) * (lengths > 0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                made = [batch.column(f.name) for f in kept] + [mixture(batch.column(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(made, names=[*(f.name for f in kept), *columns])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` array<double>" for c in columns)])
    return ship(rows).mapInArrow(run, schema)
