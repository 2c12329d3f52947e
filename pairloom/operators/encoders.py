"""Pair encoders: what attention between the two texts' token vectors says of a pair, and trained heads over it.

An encoder turns the token vectors of a pair into one row of numbers, a batch of pairs at a time; a head, a perceptron with one hidden layer that MLlib
fits on the executors, gives the pair's probability, and its hidden layer is the pair's representation. Features are made out of fold, so a pair's numbers
come from a head that never saw its label; the held-out fold says when training stops.

Token vectors come from a table (read from a file or fitted by `word_vectors`); tokens that it lacks get drawn ones that a hash of the token fixes.
Recurrent layers are running averages of the token vectors in both directions, and projections are drawn: these parts aren't trained, the vectors and the heads are.

Texts are cut after max_len tokens. Null and empty texts have no token: means, maxima and attention over nothing are zeros.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import CHARACTERS
from pairloom.operators.stacking import fold_mean, log_loss
from pairloom.operators.tfidf import folds
from pairloom.operators.vocabulary import TOKEN, words
from pairloom.plans.abreast import abreast
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

MAX_LEN = 40
#: Sentences for each partition of a vector model's training.
SENTENCES = 10_000
#: Pairs that are encoded at once; attention between all their places is held for so many.
ROWS = 32
#: Drawn vectors that a Python worker keeps, some 700 bytes each with 16 numbers.
DRAWN = 20_000


# token vectors


@functools.lru_cache(DRAWN)
def drawn_vector(token: str, size: int) -> tuple[float, ...]:
    """Numbers from -0.5 to 0.5, fixed by hashes of token and place."""
    return tuple(int(hashlib.md5(f"{token}#{d}".encode()).hexdigest()[:8], 16) / 4294967296.0 - 0.5 for d in range(size))


def character_vector(token: str, size: int, most: int = 20) -> np.ndarray:
    """The largest of each coordinate over the vectors of a token's characters, the first `most`; characters that the character vocabulary lacks share one vector."""
    return np.array([drawn_vector(c if c in CHARACTERS else "unknown character", size) for c in token[:most]]).max(0)


def least_count(counts: DataFrame, terms: int) -> int:
    """The smallest count that at most `terms` tokens reach. counts: token, n."""
    top = counts.orderBy(F.desc("n")).limit(terms + 1).agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    return 1 if top["rows"] <= terms else top["n"] + 1


def word_vectors(pairs: DataFrame, size: int = 64, terms: int = 100_000, window: int = 6, seed: int = 951, pattern: str = TOKEN) -> DataFrame:
    """token, vec: skip-gram vectors of the `terms` most frequent tokens of both texts at most."""
    sentences = Scratch(pairs.sparkSession, "sentences").keep(pairs.select(F.explode(F.array(words(F.col("question1"), pattern), words(F.col("question2"), pattern))).alias("words")))
    least = least_count(sentences.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")), terms)
    parts = max(1, sentences.count() // SENTENCES)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, numPartitions=parts, seed=seed, inputCol="words", outputCol="v").fit(sentences)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))


# attention over batches: texts are arrays (pairs, places, coordinates) with zeros for padding, masks (pairs, places)


def softmax(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Over the last axis where mask holds, zeros elsewhere."""
    top = np.where(mask, x, -np.inf).max(-1, keepdims=True, initial=-np.inf)
    raised = np.where(mask, np.exp(np.where(mask, x - np.where(np.isfinite(top), top, 0.0), 0.0)), 0.0)
    return raised / np.maximum(raised.sum(-1, keepdims=True), 1e-13)


def attend(a: np.ndarray, b: np.ndarray, of_b: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """For each place of a the mean of b, weighted by the softmax of their products."""
    return softmax(a @ b.swapaxes(1, 2) * scale, of_b[:, None, :]) @ b


def running(x: np.ndarray, mask: np.ndarray, keep: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Running averages from the first place on and from the last place back."""
    forth, back = np.zeros_like(x), np.zeros_like(x)
    for out, places in ((forth, range(x.shape[1])), (back, reversed(range(x.shape[1])))):
        state = np.zeros_like(x[:, 0])
        for t in places:
            state = keep * state + (1 - keep) * x[:, t]
            out[:, t] = state
    return forth * mask[:, :, None], back * mask[:, :, None]


def in_context(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.concatenate(running(x, mask), axis=2)


def mean_pool(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (x * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]


def max_pool(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    top = np.where(mask[:, :, None], x, -np.inf).max(1, initial=-np.inf)
    return np.where(np.isfinite(top), top, 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def projection(name: str, rows: int, columns: int) -> np.ndarray:
    """A drawn matrix."""
    return np.array([drawn_vector(f"{name} {i}", columns) for i in range(rows)]) * math.sqrt(12 / columns)


@dataclass(frozen=True)
class Batch:
    """Both sides' token vectors and masks, and which tokens of the sides are equal (pairs, places, places)."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    equal: np.ndarray


def pooled(x: Batch) -> np.ndarray:
    """Each text alone: u, v, |u - v|, u * v and the cosine of the means."""
    u, v = mean_pool(x.a, x.of_a), mean_pool(x.b, x.of_b)
    length = np.maximum(np.sqrt((u * u).sum(1) * (v * v).sum(1)), 1e-8)
    return np.concatenate([u, v, np.abs(u - v), u * v, ((u * v).sum(1) / length)[:, None]], axis=1)


def joint(x: Batch, layers: int = 2) -> np.ndarray:
    """Both texts as one sequence, each marked with its side, after a token that starts as their mean and stands for the sequence: its vector after self-attention."""
    marks = projection("side", 2, x.a.shape[2])
    whole = np.concatenate([x.a + marks[0] * x.of_a[:, :, None], x.b + marks[1] * x.of_b[:, :, None]], axis=1)
    mask = np.concatenate([x.of_a, x.of_b], axis=1)
    sequence = np.concatenate([mean_pool(whole, mask)[:, None], whole], axis=1)
    mask = np.concatenate([np.ones((len(mask), 1), bool), mask], axis=1)
    for _ in range(layers):
        sequence = sequence + attend(sequence, sequence, mask, 1 / math.sqrt(sequence.shape[2])) * mask[:, :, None]
    return sequence[:, 0]


def aligned(x: Batch) -> np.ndarray:
    """Soft alignment: each place in context beside what it attends to in the other text, their difference and product; again in context; means and maxima of both sides."""
    a, b = in_context(x.a, x.of_a), in_context(x.b, x.of_b)
    sides = []
    for one, own, other, of_other in ((a, x.of_a, b, x.of_b), (b, x.of_b, a, x.of_a)):
        met = attend(one, other, of_other) * own[:, :, None]
        sides.append((in_context(np.concatenate([one, met, one - met, one * met], axis=2), own), own))
    return np.concatenate([pool(s, m) for pool in (mean_pool, max_pool) for s, m in sides], axis=1)


def interaction(x: Batch, layers: int = 2) -> np.ndarray:
    """Maxima and means over all pairs of places (i, j) of a_i, b_j, a_i - b_j and a_i * b_j, after self-attention.

    The tensor over pairs of places is never built: extremes of differences and products are those of extremes, and their means come from the means."""
    enc = []
    for side, mask in ((x.a, x.of_a), (x.b, x.of_b)):
        for _ in range(layers):
            met = attend(side, side, mask, 1 / math.sqrt(side.shape[2])) * mask[:, :, None]
            side = side + met
        enc.append((max_pool(met, mask), -max_pool(-met, mask), mean_pool(met, mask)))
    (top_a, low_a, mean_a), (top_b, low_b, mean_b) = enc
    both = (x.of_a.any(1) & x.of_b.any(1))[:, None]
    products = np.max([top_a * top_b, top_a * low_b, low_a * top_b, low_a * low_b], axis=0)
    return np.concatenate([top_a, top_b, both * (top_a - low_b), both * products, mean_a, mean_b, both * (mean_a - mean_b), both * mean_a * mean_b], axis=1)


def similarity_channels(x: Batch) -> np.ndarray:
    """(pairs, 4, places, places): cosines of encoded tokens, of attended with encoded ones both ways, and whether tokens are equal; zeros on padding."""
    scale = 1 / math.sqrt(x.a.shape[2])
    a, b = (s + attend(s, s, m, scale) * m[:, :, None] for s, m in ((x.a, x.of_a), (x.b, x.of_b)))
    met_a, met_b = attend(a, b, x.of_b, scale), attend(b, a, x.of_a, scale)
    maps = [unit(p) @ unit(q).swapaxes(1, 2) for p, q in ((a, b), (met_a, b), (a, met_b))]
    return np.stack([*maps, x.equal.astype(float)], axis=1) * (x.of_a[:, None, :, None] & x.of_b[:, None, None, :])


def channels(x: Batch, grid: int = 4) -> np.ndarray:
    """Maxima, then means, of the similarity channels over a grid of fields of places."""
    maps = similarity_channels(x)
    n, c, length, _ = maps.shape
    fields = maps.reshape(n, c, grid, length // grid, grid, length // grid)
    return np.concatenate([fields.max((3, 5)).reshape(n, -1), fields.mean((3, 5)).reshape(n, -1)], axis=1)


def attention_weights(kind: str, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Weights over b's places for each of a's: by cosines, by products of projections, or by a drawn vector's product with the tanh of their sum or with the projection of both."""
    d = a.shape[2]
    if kind == "cosine":
        return softmax(unit(a) @ unit(b).swapaxes(1, 2), mask)
    if kind == "multiplicative":
        w = projection("multiplicative", d, d)
        return softmax((a @ w) @ (b @ w).swapaxes(1, 2), mask)
    if kind == "additive":
        w, v = projection("additive", d, d), projection("additive vector", 1, d)[0]
        return softmax(np.tanh((a @ w)[:, :, None] + (b @ w)[:, None]) @ v, mask)
    w, v = projection("concat", 2 * d, d), projection("concat vector", 1, d)[0]
    return softmax(((a @ w[:d]) @ v)[:, :, None] + ((b @ w[d:]) @ v)[:, None], mask)


ATTENTIONS = ("cosine", "multiplicative", "additive", "concat")


def perspectives(name: str, count: int, d: int) -> np.ndarray:
    """Drawn weights of coordinates, a row for each perspective."""
    return np.abs(projection(name, count, d))


def cosines(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The cosine of a and b under each row of coordinate weights (last axis)."""
    w = w * w
    return (a * b) @ w.T / ((np.sqrt(a * a @ w.T) + 1e-6) * (np.sqrt(b * b @ w.T) + 1e-6))


def matching_sequence(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, count: int) -> np.ndarray:
    """For each place of a its match with b from `count` perspectives: with b's last place, with all its places on average, with what it attends to, and with the place it attends to most."""
    d = a.shape[2]
    full, pool, attentive, most = (perspectives(n, count, d) for n in ("full", "pooling", "attentive", "max-attentive"))
    rows = np.arange(len(a))
    last = b[rows, np.maximum(of_b.sum(1) - 1, 0)][:, None]
    every = np.stack([unit(a * w) @ unit(b * w).swapaxes(1, 2) for w in pool], axis=-1)
    on_average = (every * of_b[:, None, :, None]).sum(2) / np.maximum(of_b.sum(1), 1)[:, None, None]
    pairs = of_a[:, :, None] & of_b[:, None, :]
    weights = [attention_weights(kind, a, b, pairs) for kind in ATTENTIONS]
    attended = np.mean([cosines(a, w @ b, attentive) for w in weights], axis=0)
    chosen = b[rows[:, None], np.mean(weights, axis=0).argmax(2)]
    return np.concatenate([cosines(a, last, full), on_average, attended, cosines(a, chosen, most)], axis=2) * (of_a & of_b.any(1)[:, None])[:, :, None]


def matching(x: Batch, count: int = 8) -> np.ndarray:
    """Matches from many perspectives, both ways and in both reading directions; maxima and means over places."""
    out = []
    for a, b in zip(running(x.a, x.of_a), running(x.b, x.of_b)):
        for p, q, of_p, of_q in ((a, b, x.of_a, x.of_b), (b, a, x.of_b, x.of_a)):
            found = matching_sequence(p, q, of_p, of_q, count)
            out += [max_pool(found, of_p), mean_pool(found, of_p)]
    return np.concatenate(out, axis=1)


#: Encoders, and the width of their heads' hidden layer.
ENCODERS: dict[str, tuple[Callable[[Batch], np.ndarray], int]] = {"pooled": (pooled, 128), "joint": (joint, 128), "aligned": (aligned, 100), "interaction": (interaction, 192), "channels": (channels, 64), "matching": (matching, 100)}


# encoding tables of pairs


def _places(texts: list[list[str]], known: dict[str, int], length: int) -> np.ndarray:
    """The tokens' numbers by place, -1 for padding; new tokens get the next number."""
    out = np.full((len(texts), length), -1)
    for i, tokens in enumerate(texts):
        out[i, : len(tokens)] = [known.setdefault(t, len(known)) for t in tokens]
    return out


def batch_of(a: list[list[str]], b: list[list[str]], vector: Callable[[str], np.ndarray], size: int, length: int) -> Batch:
    """The vector of each distinct token is asked for once."""
    known: dict[str, int] = {}
    x, y = _places(a, known, length), _places(b, known, length)
    table = np.zeros((len(known) + 1, size))
    for i, token in enumerate(known):
        table[i] = vector(token)
    return Batch(table[x], table[y], x >= 0, y >= 0, (x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None])


def _own_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, own: the vectors of the tokens that a pair holds, by a join. One row for a pair, with 2 max_len vectors at most."""
    held = rows.select("id", F.explode(F.array_union("question1", "question2")).alias("token"))
    return held.join(vectors, "token").groupBy("id").agg(F.collect_list(F.struct("token", "vec")).alias("own"))


def encode(pairs: DataFrame, encoder: str, size: int = 32, vectors: DataFrame | None = None, terms: int = 100_000, characters: int = 0, max_len: int = MAX_LEN, pattern: str = TOKEN) -> DataFrame:
    """id, x array<double>: what the encoder makes of each pair.

    vectors: token, vec of `size`. A table of `terms` rows at most is sent to the executors, a larger one is joined to the pairs' tokens; tokens without a vector get
    drawn ones. With `characters`, so many coordinates from the token's characters follow."""
    tokens = (F.slice(words(F.col(c), pattern), 1, max_len).alias(c) for c in ("question1", "question2"))
    rows = ship(pairs).select(F.col("id").cast("long").alias("id"), *tokens)
    found = pa.table({"token": pa.array([], pa.string()), "vec": pa.array([], pa.list_(pa.float64()))}) if vectors is None else vectors.select("token", F.col("vec").cast("array<double>").alias("vec")).limit(terms + 1).toArrow()
    few = found.slice(0, found.num_rows if found.num_rows <= terms else 0).combine_chunks()
    table = few["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, -1) if few.num_rows else np.zeros((0, size))
    sent = pairs.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(few["token"].to_pylist())}, table))
    if found.num_rows > terms:
        rows = rows.join(_own_vectors(rows, vectors.select("token", "vec")), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ENCODERS[encoder][0]
        number, table = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                own = {x["token"]: np.array(x["vec"]) for r in (batch.column(3).to_pylist() if batch.num_columns > 3 else ()) for x in r or ()}

                def vector(token: str, own: dict = own) -> np.ndarray:
                    known = own[token] if token in own else table[number[token]] if token in number else None
                    known = np.array(drawn_vector(token, size)) if known is None else known
                    return np.concatenate([known, character_vector(token, characters)]) if characters else known

                made = work(batch_of(batch.column(1).to_pylist(), batch.column(2).to_pylist(), vector, size + characters, max_len))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "x"])

    return rows.mapInArrow(run, "id long, x array<double>")


# heads


@dataclass(frozen=True)
class Head:
    """A fitted head: scaling, layers, and the loss on the held-out rows that it was chosen by."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[int]
    weights: np.ndarray
    loss: float
    epochs: int

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matrix and offset of the hidden layer and of the output, as MLlib lays them out: a layer's matrix by columns, then its offset."""
        d, h, o = self.layers
        at = np.cumsum([0, d * h, h, h * o, o])
        w = [self.weights[a:b] for a, b in zip(at[:-1], at[1:])]
        return w[0].reshape(d, h), w[1], w[2].reshape(h, o), w[3]


def fit_head(rows: DataFrame, width: int, epochs: int = 50, steps: int = 10, patience: int = 3, seed: int = 951, path: str | None = None, warm: bool = False) -> Head:
    """A head for rows (x, is_duplicate, held), trained where held is false. An epoch is `steps` steps of L-BFGS from the weights of the one before; the epoch with the least log loss
    on the held rows is kept (and saved with the scaling to `path`, if given), and training ends after `patience` epochs without a better one. `warm` goes on from what
    `path` holds, under its scaling."""
    scratch = Scratch(rows.sparkSession, "head")
    table = rows.select(array_to_vector("x").alias("x"), F.col("is_duplicate").cast("double").alias("label"), "held")
    scaler, best = PipelineModel.load(path).stages if warm else (StandardScaler(inputCol="x", outputCol="features", withMean=True, withStd=True).fit(table.where("not held")), None)
    table = scratch.keep(scaler.transform(table).select("features", "label", "held"))
    train, held = table.where("not held"), table.where("held")
    layers = [len(scaler.mean), width, 2]
    make = MultilayerPerceptronClassifier(layers=layers, maxIter=steps, seed=seed, tol=1e-9)
    least, bad, done = math.inf, 0, 0
    if best is not None:
        least = _held_loss(best, held)
        make = make.setInitialWeights(best.weights)
    for _ in range(epochs):
        model = make.fit(train)
        done += 1
        loss = _held_loss(model, held)
        if loss < least:
            best, least, bad = model, loss, 0
            if path is not None:
                PipelineModel([scaler, model]).write().overwrite().save(path)
        else:
            bad += 1
            if bad >= patience:
                break
        make = make.setInitialWeights(model.weights)
    return _head(scaler, model if best is None else best, least, done)


def _head(scaler: StandardScalerModel, model: MultilayerPerceptronClassificationModel, loss: float = math.inf, epochs: int = 0) -> Head:
    return Head(np.array(scaler.mean), np.array(scaler.std), list(model.getLayers()), np.array(model.weights), loss, epochs)


def load_head(path: str) -> Head:
    """A head that `fit_head` saved."""
    return _head(*PipelineModel.load(path).stages)


def _held_loss(model: MultilayerPerceptronClassificationModel, held: DataFrame) -> float:
    """Infinite without held rows, so that the first epoch stays."""
    loss = model.transform(held).agg(log_loss(vector_to_array("probability")[1], F.col("label")).alias("loss")).first()["loss"]
    return math.inf if loss is None or math.isnan(loss) else loss


def apply_head(head: Head, rows: DataFrame) -> DataFrame:
    """id, prob, rep array<double>: the head's probability and hidden layer for rows (id, x)."""
    w, c, v, o = head.parts()
    scale = np.where(head.scale > 0, 1 / np.where(head.scale > 0, head.scale, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(head.mean))
            hidden = 1 / (1 + np.exp(-((x - head.mean) * scale @ w + c)))
            out = hidden @ v + o
            prob = 1 / (1 + np.exp(out[:, 0] - out[:, 1]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * hidden.shape[1]), pa.array(hidden.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prob), flat], names=["id", "prob", "rep"])

    return rows.select("id", "x").mapInArrow(run, "id long, prob double, rep array<double>")


def pair_features(pairs: DataFrame, encoder: str, k: int = 5, test: DataFrame | None = None, vectors: DataFrame | None = None, size: int = 32, width: int | None = None, epochs: int = 50, steps: int = 10, patience: int = 3, path: str | None = None, warm: Collection[int] = (), done: Collection[int] = (), **options) -> tuple[DataFrame, DataFrame | None]:
    """id, prob, feature_0, ... of each pair by heads fitted on the other folds, and for test pairs the means over the folds' heads.

    With `path`, fold i's head is saved to path/i; folds in `warm` go on from there, those in `done` are taken as they are there (with the vectors that they were fitted on). Without `vectors` skip-gram vectors are fitted on the pairs' and test pairs' texts, which needs no label."""
    scratch = Scratch(pairs.sparkSession, "encoded")
    texts = ["id", "question1", "question2"]
    pairs = scratch.keep(pairs.select(*texts, "is_duplicate"))
    if vectors is None:
        vectors = word_vectors(pairs.select(*texts) if test is None else pairs.select(*texts).union(test.select(*texts)), size, pattern=options.get("pattern", TOKEN))
    vectors = scratch.keep(vectors)
    width = ENCODERS[encoder][1] if width is None else width
    coded = scratch.keep(encode(pairs, encoder, size, vectors, **options))
    rows = scratch.keep(folds(coded.join(pairs.select(F.col("id").cast("long").alias("id"), "is_duplicate"), "id"), k))
    asked = None if test is None else scratch.keep(encode(test, encoder, size, vectors, **options))
    wide = lambda df: df.select("id", "prob", *(F.get("rep", F.lit(i)).alias(f"feature_{i}") for i in range(width)))

    def fitted(fold: int) -> Head:
        own = None if path is None else f"{path}/{fold}"
        return load_head(own) if fold in done else fit_head(rows.withColumn("held", F.col("fold") == fold), width, epochs, steps, patience, path=own, warm=fold in warm)

    heads = abreast(pairs.sparkSession, fitted, range(k))
    made = functools.reduce(DataFrame.union, (apply_head(head, rows.where(F.col("fold") == fold)) for fold, head in enumerate(heads)))
    tested = None if asked is None else fold_mean(functools.reduce(DataFrame.union, (wide(apply_head(head, asked)) for head in heads)))
    return wide(made), tested
