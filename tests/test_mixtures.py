import random

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array

from pairloom.functions.sums import sums
from pairloom.operators import mixtures, topics

WORDS = [["red", "blue", "green", "pink"], ["cat", "dog", "cow", "hen"], ["one", "two", "six", "ten"]]


def _corpus(n: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return [" ".join(r.choices(r.choice(WORDS), k=6) + r.choices(r.choice(WORDS), k=r.randrange(5))) for _ in range(n)]


def _batch(n: int = 150, terms: int = 2000) -> tuple:
    r = np.random.default_rng(5)
    lengths = r.integers(0, 120, n)
    beta = np.vstack([r.gamma(100, 0.01, (terms, 10)), np.zeros(10)])
    return np.concatenate([r.choice(terms, k, replace=False) for k in lengths]), r.integers(1, 4, lengths.sum()).astype(float), lengths, beta, np.full(10, 0.1), r.gamma(100, 0.01, 10)


def _one_by_one(terms, counts, lengths, beta, alpha, start) -> tuple[np.ndarray, int]:
    """MLlib's loop over a text at a time, and its steps."""
    out, steps, at = np.tile(start, (len(lengths), 1)), 0, 0
    for i, n in enumerate(lengths):
        b, c, gamma, change = beta[terms[at : at + n]], counts[at : at + n], start, float(n > 0)
        at += n
        while change > 1e-3:
            theta = np.exp(mixtures.digamma(gamma))
            after = theta * (b.T @ (c / (b @ theta + 1e-100))) + alpha
            gamma, change, steps = after, np.abs(after - gamma).mean(), steps + 1
        out[i] = gamma
    return out, steps


def test_gamma_functions():
    x = np.array([1.0, 0.1, 5.0])
    assert np.allclose(mixtures.digamma(x), [-0.5772156649, -10.4237549404, 1.5061176684], atol=1e-8)
    assert np.allclose(mixtures.exp_digamma(x), np.exp(mixtures.digamma(x)), atol=1e-12)
    assert np.allclose(mixtures.trigamma(x[:2]), [1.6449340668, 101.4332991508], atol=1e-7)


def test_inference_ends_where_single_steps_end(monkeypatch):
    """Near equal topics: the same mixtures in a third of the steps, but for few texts with more than one settled mixture."""
    batch, steps, real = _batch(), [], mixtures.exp_digamma
    monkeypatch.setattr(mixtures, "exp_digamma", lambda x: steps.append(len(x)) or real(x))
    got = mixtures.inferred(*batch)
    plain, single = _one_by_one(*batch)
    assert sum(steps) < single / 3, (sum(steps), single)
    near = np.abs(got / got.sum(1, keepdims=True) - plain / plain.sum(1, keepdims=True)).sum(1)
    assert (near < 0.05).mean() > 0.9
    terms, counts, lengths, beta, alpha, _ = batch
    row = np.repeat(np.arange(len(lengths)), lengths)
    theta = real(got)
    b = beta[terms]
    after = np.zeros_like(got)
    np.add.at(after, row, b * (counts / ((theta[row] * b).sum(1) + 1e-100))[:, None])
    held = lengths > 0
    assert (np.abs(theta * after + alpha - got).mean(1)[held] < 2e-3).all()


def test_mixtures_are_those_of_mllib(spark):
    """Under the same topics."""
    pairs = spark.createDataFrame([(i, t, "") for i, t in enumerate(_corpus(80))], "id long, question1 string, question2 string")
    model = topics.topic_model(pairs, topics=3, rounds=2)
    counted = model.counts(pairs.select("id", "question1"), "question1")
    theirs = LDA(k=3, maxIter=20, subsamplingRate=1.0, seed=1, featuresCol="question1").fit(counted)
    weights, alpha = theirs.topicsMatrix().toArray(), theirs.estimatedDocConcentration().toArray()
    got = {r.id: r.question1 for r in mixtures.shares(counted, ["question1"], weights, alpha, 7).collect()}
    want = {r.id: r.p for r in theirs.transform(counted).select("id", vector_to_array("topicDistribution").alias("p")).collect()}
    assert len(got) == 80 and np.mean([np.abs(np.subtract(got[i], want[i])).sum() < 0.02 for i in got]) > 0.95


def test_topics_of_texts(spark):
    """Topics are found, copies count, texts without words have no mixture, and a text that occurs often is inferred once a round."""
    corpus = _corpus(120)
    rows = [(i, corpus[i], corpus[(i + 1) % 120]) for i in range(120)] + [(200 + i, "red blue pink", "cat dog hen") for i in range(60)] + [(300, None, ""), (301, "zz", "the")]
    pairs = spark.createDataFrame(rows, "id long, question1 string, question2 string")
    held = {r.copies for r in topics._held(pairs).collect()}
    assert held >= {60} and topics._held(pairs).count() <= 120 + 2 + 4
    model = topics.topic_model(pairs, topics=3, rounds=30)
    terms = model.words.stages[-1].vocabulary
    assert set(terms) == {w for group in WORDS for w in group}
    shares = model.weights / model.weights.sum(0)
    best = {w: shares[terms.index(w)].argmax() for w in terms}
    assert len({best[g[0]] for g in WORDS}) == 3 and all(len({best[w] for w in g}) == 1 for g in WORDS)
    made = {r.id: r for r in topics.topic_pairs(model, pairs).collect()}
    assert sorted(made) == sorted(r[0] for r in rows)
    assert made[200].dot < 0.4 and made[300].dot == 0 and made[301].dot == 0
    assert topics.topic_features(pairs.where("id = 300")).count() == 1


def test_sums_of_blocks(spark):
    rows = spark.range(40).repartition(3)

    def work(batches):
        out = np.zeros((10, 2))
        for batch in batches:
            np.add.at(out, batch.column(0).to_numpy() % 10, 1.0)
        yield out

    for block in (1, 4, 16):
        assert (sums(rows, work, (10, 2), block) == 4).all()
