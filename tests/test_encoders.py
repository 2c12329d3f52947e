"""Pair encoders against plain loops, heads against MLlib, and what they learn."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pairloom.operators import encoders

PAIRS = "id long, question1 string, question2 string, is_duplicate int"


def vector(token):
    return np.array(encoders.drawn_vector(token, 6))


def a_batch(seed=0, n=5, length=8):
    r = random.Random(seed)
    texts = [[[r.choice("abcdefg") for _ in range(r.randint(1, length))] for _ in range(n)] for _ in range(2)]
    return texts, encoders.batch_of(*texts, vector, 6, length)


def attended(a, b, scale=1.0):
    out = []
    for x in a:
        e = [math.exp(scale * float(x @ y)) for y in b]
        out.append(sum(w * y for w, y in zip(e, b)) / sum(e))
    return out


def in_context(rows):
    def one(rows):
        state, out = np.zeros_like(rows[0]), []
        for x in rows:
            state = 0.5 * state + 0.5 * x
            out.append(state)
        return out

    return [np.concatenate(p) for p in zip(one(rows), one(rows[::-1])[::-1])]


def test_soft_alignment_by_loops():
    texts, batch = a_batch()
    got = encoders.aligned(batch)
    for i, (s, t) in enumerate(zip(*texts)):
        a, b = (in_context([vector(x) for x in side]) for side in (s, t))
        sides = []
        for one, other in ((a, b), (b, a)):
            sides.append(np.array(in_context([np.concatenate([x, m, x - m, x * m]) for x, m in zip(one, attended(one, other))])))
        assert np.allclose(got[i], np.concatenate([f(x) for f in (lambda x: x.mean(0), lambda x: x.max(0)) for x in sides]))


def test_interaction_is_that_of_the_whole_tensor():
    texts, batch = a_batch(1)
    got = encoders.interaction(batch)
    scale = 1 / math.sqrt(6)
    for i, (s, t) in enumerate(zip(*texts)):
        enc = []
        for side in (s, t):
            x = [vector(w) for w in side]
            for _ in range(2):
                met = attended(x, x, scale)
                x = [p + q for p, q in zip(x, met)]
            enc.append(np.array(met))
        a, b = enc[0][:, None], enc[1][None, :]
        tensor = np.concatenate([a + 0 * b, b + 0 * a, a - b, a * b], axis=2)
        assert np.allclose(got[i], np.concatenate([tensor.max((0, 1)), tensor.mean((0, 1))]))


def test_matching_by_loops():
    texts, batch = a_batch(2)
    of_a, of_b = batch.of_a, batch.of_b
    got = encoders.matching_sequence(batch.a, batch.b, of_a, of_b, 3)

    def cosine(x, y, w):
        return float((w * x) @ (w * y)) / ((np.linalg.norm(w * x) + 1e-6) * (np.linalg.norm(w * y) + 1e-6))

    full, pooling, attentive, most = (encoders.perspectives(n, 3, 6) for n in ("full", "pooling", "attentive", "max-attentive"))
    for i, (s, t) in enumerate(zip(*texts)):
        b = [vector(w) for w in t]
        assert not got[i, len(s) :].any()
        for j, x in enumerate(vector(w) for w in s):
            weights = [encoders.attention_weights(kind, batch.a, batch.b, of_a[:, :, None] & of_b[:, None, :])[i, j, : len(t)] for kind in encoders.ATTENTIONS]
            assert all(abs(w.sum() - 1) < 1e-9 for w in weights)
            want = [cosine(x, b[-1], w) for w in full]
            want += [sum(float((w * x) @ (w * y)) / (np.linalg.norm(w * x) * np.linalg.norm(w * y)) for y in b) / len(b) for w in pooling]
            want += [sum(cosine(x, sum(p * y for p, y in zip(v, b)), w) for v in weights) / 4 for w in attentive]
            want += [cosine(x, b[int(np.mean(weights, axis=0).argmax())], w) for w in most]
            assert np.allclose(got[i, j], want)


def test_attention_kinds_by_their_formulas():
    a, b = np.random.default_rng(0).normal(size=(2, 1, 3, 4))
    mask = np.array([[[True, True, False]] * 3])
    w, v = encoders.projection("concat", 8, 4), encoders.projection("concat vector", 1, 4)[0]
    logits = np.array([[(np.concatenate([x, y]) @ w) @ v for y in b[0]] for x in a[0]])
    assert np.allclose(encoders.attention_weights("concat", a, b, mask)[0], encoders.softmax(logits, mask[0]))
    w, v = encoders.projection("additive", 4, 4), encoders.projection("additive vector", 1, 4)[0]
    logits = np.array([[np.tanh(x @ w + y @ w) @ v for y in b[0]] for x in a[0]])
    assert np.allclose(encoders.attention_weights("additive", a, b, mask)[0], encoders.softmax(logits, mask[0]))
    assert (encoders.attention_weights("cosine", a, b, mask)[..., 2] == 0).all()


@pytest.mark.parametrize("name", list(encoders.ENCODERS))
def test_padding_and_empty_texts(name):
    """Longer padding changes nothing where nothing is pooled by place; empty texts give finite numbers."""
    texts = [[["a", "b"], [], ["c"], []], [["b"], ["a"], [], []]]
    rows = [encoders.ENCODERS[name][0](encoders.batch_of(*texts, vector, 6, length)) for length in (4, 8)]
    assert all(np.isfinite(r).all() for r in rows)
    if name != "channels":
        assert np.allclose(*rows)
    assert name == "joint" or not rows[0][3].any()


def test_encoding_by_broadcast_and_by_join(spark):
    r = random.Random(3)
    pairs = spark.createDataFrame([(i, " ".join(r.choices(["red", "blue", "green", "zz"], k=5)), None if i == 3 else r.choice(["", "red zz", "blue"]), 0) for i in range(30)], PAIRS)
    known = spark.createDataFrame([(w, [float(i), 1.0, 0.5]) for i, w in enumerate(["red", "blue", "green"])], "token string, vec array<double>")
    sent, joined = ({r.id: r.x for r in encoders.encode(pairs, "aligned", 3, known, terms, characters=2).collect()} for terms in (3, 2))
    assert len(sent) == 30 and all(np.allclose(sent[i], joined[i]) for i in sent)
    assert len(sent[0]) == 4 * 16 * 5


def test_vectors_are_bounded_by_their_counts(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "token string, n long")
    assert [encoders.least_count(counts, n) for n in (4, 3, 2, 1)] == [1, 2, 4, 4]
    pairs = spark.createDataFrame([(i, "x y z", "x y", 0) for i in range(20)] + [(99, "rare", "x", 0)], PAIRS)
    assert {r.token for r in encoders.word_vectors(pairs, 4, terms=3).collect()} == {"x", "y", "z"}


def test_character_vectors():
    c = [np.array(encoders.drawn_vector(x, 4)) for x in "ab"]
    assert np.allclose(encoders.character_vector("abba", 4), np.maximum(*c))
    assert np.allclose(encoders.character_vector("é", 4), encoders.character_vector("ü", 4))


def test_heads_are_those_of_mllib(spark, tmp_path):
    g = np.random.default_rng(5)
    rows = [(i, [float(v) for v in x], int(x[0] * x[1] > 0), i % 5 == 0) for i, x in enumerate(g.normal(size=(400, 3)))]
    table = spark.createDataFrame(rows, "id long, x array<double>, is_duplicate int, held boolean")
    path = str(tmp_path / "head")
    head = encoders.fit_head(table, 6, epochs=12, steps=10, path=path)
    got = {r.id: r for r in encoders.apply_head(head, table).collect()}
    model = PipelineModel.load(path).stages[1]
    assert (encoders.load_head(path).weights == head.weights).all()
    scaled = F.transform("x", lambda v, i: (v - F.element_at(F.array(*map(F.lit, head.mean.tolist())), i + 1)) / F.element_at(F.array(*map(F.lit, head.scale.tolist())), i + 1))
    for r in model.transform(table.select("id", array_to_vector(scaled).alias("features"))).select("id", vector_to_array("probability")[1].alias("p")).collect():
        assert abs(got[r.id].prob - r.p) < 1e-9
    assert head.loss < 0.35 and all(len(r.rep) == 6 for r in got.values())
    further = encoders.fit_head(table, 6, epochs=1, steps=5, path=path, warm=True)
    assert further.loss <= head.loss + 1e-9


def test_features_out_of_fold_tell_copies_from_others(spark, tmp_path):
    """Copies with other words in between against unrelated texts; the vectors are fitted, the labels of a fold are not seen by its head."""
    r = random.Random(7)
    topics = [["red", "blue", "green"], ["cat", "dog", "cow"], ["one", "two", "three"]]
    rows = []
    for i in range(150):
        t = r.choice(topics)
        same = i % 2
        u = t if same else r.choice([x for x in topics if x is not t])
        rows.append((i, " ".join(r.choices(t, k=5)), " ".join(r.choices(u, k=5)), same))
    pairs = spark.createDataFrame(rows, PAIRS)
    made, tested = encoders.pair_features(pairs, "pooled", k=2, test=pairs.where("id < 10").drop("is_duplicate"), size=4, width=5, epochs=3, steps=15, path=str(tmp_path))
    got = {x.id: x.prob for x in made.collect()}
    assert sorted(got) == list(range(150)) and made.columns == ["id", "prob", *(f"feature_{i}" for i in range(5))]
    assert sum((got[i] > 0.5) == bool(i % 2) for i in got) > 135
    assert tested.count() == 10 and tested.columns == made.columns
    vectors = spark.createDataFrame([("red", [1.0, 0.0, 0.0, 0.0])], "token string, vec array<double>")
    for again in ({"done": (0, 1)}, {"done": (0,), "warm": (1,)}):
        other, _ = encoders.pair_features(pairs, "pooled", k=2, vectors=vectors, size=4, width=5, epochs=1, steps=2, path=str(tmp_path), **again)
        assert other.count() == 150


def test_memory_of_matching_is_bounded():
    """Batches as large as tables are encoded in hold little, and drawn vectors don't pile up with the vocabulary."""
    import tracemalloc

    words = [[f"w{i}-{t}" for t in range(40)] for i in range(encoders.ROWS)]
    batch = encoders.batch_of(words, words, lambda w: np.full(16, len(w) / 8), 16, 40)
    tracemalloc.start()
    encoders.matching(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and encoders.drawn_vector.cache_info().maxsize <= 20_000


def test_a_batch_asks_for_each_token_once():
    """Vectors, masks and equal places of texts of all lengths."""
    asked = []
    vector = lambda w: asked.append(w) or np.array([len(w), ord(w[0])], float)
    a, b = [["x", "yy", "x"], [], ["zzz"]], [["yy", "x"], ["x"], []]
    got = encoders.batch_of(a, b, vector, 2, 4)
    assert sorted(asked) == ["x", "yy", "zzz"]
    for texts, x, mask in ((a, got.a, got.of_a), (b, got.b, got.of_b)):
        for i, tokens in enumerate(texts):
            assert mask[i].tolist() == [t < len(tokens) for t in range(4)]
            assert x[i].tolist() == [[float(len(w)), float(ord(w[0]))] for w in tokens] + [[0.0, 0.0]] * (4 - len(tokens))
    assert np.argwhere(got.equal).tolist() == [[0, 0, 1], [0, 1, 0], [0, 2, 1]]


def test_pairs_are_made_once(spark):
    """Features read a written table, not the pairs' own plan, however often they need them."""
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, "red blue" if i % 3 else None, "blue green", i % 2) for i in range(40)]
    pairs = spark.createDataFrame(rows, PAIRS).mapInArrow(mark, PAIRS)
    got, _ = encoders.pair_features(pairs, "pooled", k=2, size=4, width=3, epochs=1, steps=2)
    assert got.count() == 40 and made.value == 40
