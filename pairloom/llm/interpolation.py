"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980).

A token's probability mixes maximum-likelihood estimates of all orders: sum over n of weight_n(bucket) c(h w) / c(h), down to the uniform 1 / (V + 1), which leaves room
for one unknown token. The bucket is the longest context that was seen in training, and its count by powers of two. The weights are learned by
expectation-maximisation on counts held out from the estimates: the documents of one fold of the training documents (the deleted part) are scored by
estimates from the others. Then all training documents give the estimates. Weights are kept above LEAST, so every text has a probability.

Work: texts are read once, into blocks of about BLOCK tokens that keep their distinct tokens' hashes and each token's place among them. A block sends each of its
distinct n-grams once, as a 62-bit hash with its count, to the part of the hash space that it falls in; parts add up and answer in the same order; so a frequent n-gram
is a row for each block, however often it stands there, and what is gathered grows with the corpus. Sent hashes are sorted, as differences. A part is about
PART n-grams, a block or part is what a task holds; a text longer than a block is a block of its own.

Null texts are empty; an empty text is its end alone. Null doc_ids count as an empty id (training). Repeated rows are documents each; a very long word is one token. An empty
table gives an empty result; without training documents the base score is 0 and weights are even. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import finish, windows, words_of
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

#: Tokens in a block and n-grams in a part, about.
BLOCK, PART = 1 << 20, 1 << 21
#: Rounds of expectation-maximisation at most, the change of a weight at which it ends, and the least weight.
ROUNDS, CHANGE, LEAST = 30, 1e-3, 1e-6
#: Buckets of a context's length: counts by powers of two.
SPAN = 64
#: Tokens that no text holds, as no word has white space.
BEGIN, END = b"\t", b"\n"

STATE = "block long, dev boolean, ids array<long>, folds array<int>, sizes array<long>, hashes binary, n int, codes binary, tokens long"
SENT = "part int, block long, dev boolean, n int, grams binary, counts binary"
ANSWERED = "block long, part int, n int, kept binary, dev binary, vocabulary long"


def _pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), "zstd", asbytes=True) if len(a) else b""


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel()


class _Numbers(dict):
    """Numbers tokens by first appearance."""

    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self)
        return n


class _Open:
    """A block that is being filled."""

    def __init__(self) -> None:
        self.numbers, self.codes, self.docs, self.tokens = _Numbers({BEGIN: 0, END: 1}), [], [], 0

    def add(self, doc_id: int | None, fold: int, text: bytes | None) -> None:
        words = words_of(text)
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.codes.append(np.ones(1, np.uint32))
        self.docs.append((doc_id, fold, len(words) + 1))
        self.tokens += len(words) + 1

    def row(self, block: int, dev: bool) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        ids, folds, sizes = zip(*self.docs)
        values = [[block], [dev], [ids], [folds], [sizes], [hashes.tobytes()], [len(hashes)], [_pack(np.concatenate(self.codes))], [self.tokens]]
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "dev", "ids", "folds", "sizes", "hashes", "n", "codes", "tokens"])


def _blocks(dev_fold: int):
    """Rows (doc_id, fold, text) to blocks; documents of the deleted part have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, blocks = TaskContext.get().partitionId() << 32, {False: _Open(), True: _Open()}
        for batch in batches:
            for doc_id, fold, text in zip(*batch.columns):
                dev = fold.as_py() == dev_fold
                blocks[dev].add(doc_id.as_py(), fold.as_py(), text.as_py())
                if blocks[dev].tokens >= BLOCK:
                    yield blocks[dev].row(block, dev)
                    block, blocks[dev] = block + 1, _Open()
        for dev, left in blocks.items():
            if left.docs:
                yield left.row(block, dev)
                block += 1

    return run


class Grams:
    """A block's tokens as n-grams: the places of their distinct hashes, in hash order."""

    def __init__(self, row: dict, order: int) -> None:
        hashes = np.frombuffer(row["hashes"], np.uint64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.ids, self.folds = row["ids"], np.asarray(row["folds"], np.int64)
        codes = _unpack(row["codes"], row["tokens"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(len(codes), bool)
        self.first[self.starts] = True
        tagged = lambda h, n: (h & ~np.uint64(3)) | np.uint64(n)  # noqa: E731  the last bits are an n-gram's order
        of_word = tagged(finish(hashes), 1)
        whole = of_word
        #: For each order the place of each token's n-gram.
        self.at = [codes]
        before, sofar = codes, hashes[codes]
        for n in range(2, order + 1):
            # an n-gram is its last word after the (n - 1)-gram that ends before it; texts begin with BEGIN
            previous = np.empty(len(codes), np.uint64)
            previous[1:] = sofar[:-1]
            previous[self.first] = hashes[0]
            sofar = windows_of(previous, hashes[codes])
            distinct, places = _distinct(sofar)
            self.at.append(places + len(whole))
            whole = np.concatenate([whole, tagged(distinct, n)])
        self.sorted = np.argsort(whole, kind="stable")
        self.grams = whole[self.sorted]
        self.total = len(whole)

    def counts(self, among: np.ndarray) -> np.ndarray:
        """How often each n-gram (in hash order) stands where `among` holds."""
        n = np.zeros(self.total, np.int64)
        for at in self.at:
            n += np.bincount(at[among], minlength=self.total)
        return n[self.sorted]

    def by_place(self, answers: np.ndarray) -> np.ndarray:
        out = np.empty(self.total, np.int64)
        out[self.sorted] = answers
        return out

    def contexts(self, n: int, counts: np.ndarray) -> np.ndarray:
        """The count of the context of each token's n-gram: the (n - 1)-gram before it; at a text's begin the number of texts, which is that of ends."""
        out = np.empty(len(self.first), np.int64)
        out[1:] = counts[self.at[n - 2]][:-1]
        out[self.first] = counts[1]
        return out


def windows_of(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return finish(before * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    places, distinct = pd.factorize(x)
    return distinct, places


def _send(order: int, parts: int, held_fold: int):
    """Blocks to messages: the n-grams of a part of the hash space, as differences, with their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row, order)
                counts = g.counts(np.repeat(g.folds != held_fold, g.sizes))
                edges = np.searchsorted(_part(g.grams, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    a, b = edges[p], edges[p + 1]
                    values = [[int(p)], [row["block"]], [row["dev"]], [int(b - a)], [_pack(np.diff(g.grams[a:b], prepend=np.uint64(0)))], [_pack(counts[a:b])]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "block", "dev", "n", "grams", "counts"])

    return run


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so sorted hashes are sorted by part."""
    return (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _answer(table: pa.Table) -> pa.Table:
    """All messages of a part to their sums over all blocks: of the kept and of the deleted training documents."""
    rows = table.select(["block", "part", "dev", "n"]).to_pylist()
    n = [r["n"] for r in rows]
    grams = np.concatenate([np.cumsum(_unpack(x.as_py(), k, np.uint64)) for x, k in zip(table["grams"], n)])
    counts = np.concatenate([_unpack(x.as_py(), k, np.int64) for x, k in zip(table["counts"], n)])
    distinct, at = np.unique(grams, return_inverse=True)
    dev = np.repeat([r["dev"] for r in rows], n)
    sums = [np.zeros(len(distinct), np.int64) for _ in range(2)]
    for i in (0, 1):
        np.add.at(sums[i], at[dev == i], counts[dev == i])
    seen = int((((distinct & np.uint64(3)) == 1) & (sums[0] + sums[1] > 0)).sum())
    edges = np.cumsum([0, *n])
    packed = [[_pack(s[at[a:b]]) for a, b in zip(edges[:-1], edges[1:])] for s in sums]
    values = [[r["block"] for r in rows], [r["part"] for r in rows], n, *packed, [seen] + [0] * (len(rows) - 1)]
    return pa.table([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["block", "part", "n", "kept", "dev", "vocabulary"])


def _answers(g: Grams, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """By place of each n-gram, its count in the kept and in the deleted training documents."""
    rows = sorted(table.select(["part", "n", "kept", "dev"]).to_pylist(), key=lambda r: r["part"])
    return tuple(g.by_place(np.concatenate([_unpack(r[c], r["n"], np.int64) for r in rows])) for c in ("kept", "dev"))


def _estimates(g: Grams, order: int, counts: np.ndarray, total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token its bucket, and its probability by each estimate (rows: uniform, then orders from 1; 0 where the context is unknown)."""
    p = np.zeros((order + 1, len(g.first)))
    p[0] = 1 / (vocabulary + 1)
    p[1] = counts[g.at[0]] / max(1, total)
    bucket = np.zeros(len(g.first), np.int16)
    for n in range(2, order + 1):
        seen = g.contexts(n, counts)
        p[n] = counts[g.at[n - 1]] / np.maximum(seen, 1)
        p[n][seen == 0] = 0
        bucket = np.where(seen > 0, (n - 1) * SPAN + np.log2(np.maximum(seen, 1)).astype(np.int16), bucket).astype(np.int16)
    return bucket, p


def even_weights(order: int) -> np.ndarray:
    """A row for each bucket: the context's length, then its count by powers of two."""
    weights = np.zeros((order * SPAN, order + 1))
    for n in range(1, order + 1):
        weights[(n - 1) * SPAN : n * SPAN, : n + 1] = 1 / (n + 1)
    return weights


def _deleted(order: int, total: int, vocabulary: int):
    """The deleted documents' tokens, as buckets and estimates from the kept ones."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        out = []
        for row in rows:
            g = Grams(row, order)
            bucket, p = _estimates(g, order, _answers(g, right)[0], total, vocabulary)
            out.append((bucket.tobytes(), p[1:].astype(np.float32).tobytes()))
        return pa.table([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["bucket", "p"])

    return run


def _expected(weights: np.ndarray, uniform: float):
    """The expected number of tokens that each bucket owes to each estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(weights)
        for batch in batches:
            for bucket, p in zip(*batch.columns):
                b = np.frombuffer(bucket.as_py(), np.int16)
                parts = [weights[b, 0] * uniform, *(weights[b, n + 1] * x for n, x in enumerate(np.frombuffer(p.as_py(), np.float32).reshape(-1, len(b))))]
                whole = sum(parts)
                for n, x in enumerate(parts):
                    sums[:, n] += np.bincount(b, x / whole, len(weights))
        i, n = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(n, pa.int32()), pa.array(sums[i, n])], names=["bucket", "n", "x"])

    return run


def learned_weights(deleted: DataFrame, order: int, vocabulary: int) -> np.ndarray:
    """Expectation-maximisation; a bucket that the deleted documents don't reach keeps even weights."""
    weights = even_weights(order)
    may = weights > 0
    for _ in range(ROUNDS):
        sums = np.zeros_like(weights)
        for r in deleted.mapInArrow(_expected(weights, 1 / (vocabulary + 1)), "bucket int, n int, x double").groupBy("bucket", "n").agg(F.sum("x").alias("x")).collect():
            sums[r["bucket"], r["n"]] = r["x"]
        all_of = sums.sum(1, keepdims=True)
        made = np.where(all_of > 0, np.maximum(sums / np.maximum(all_of, 1e-300), LEAST * may), weights)
        made /= made.sum(1, keepdims=True)
        change, weights = np.abs(made - weights).max(), made
        if change < CHANGE:
            break
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, total: int, vocabulary: int, held_fold: int, weights: np.ndarray):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            g = Grams(row, order)
            kept, dev = _answers(g, right)
            counts = kept + dev
            own = counts[g.at[0]]
            bucket, p = _estimates(g, order, counts, total, vocabulary)
            mixed = sum(weights[bucket, n] * p[n] for n in range(order + 1))
            by_doc = lambda x: np.add.reduceat(x, g.starts)
            out.append((g.ids, g.folds == held_fold, g.sizes, by_doc((own > 0).astype(np.int64)), np.full(len(g.ids), total), by_doc(np.log10((own + 1) / (total + vocabulary + 1))), by_doc(np.log10(mixed))))
        columns = [pa.chunked_array([pa.array(o[i], k) for o in out], k) for i, k in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def fold_of(doc_id: Column, folds: int) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def score_documents(docs: DataFrame, order: int = 2, folds: int = 7, held_fold: int = 2, dev_fold: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents of the held fold (crc32 of the doc_id as text, modulo folds) teach nothing; those of dev_fold are the deleted part that teaches the weights."""
    scratch = Scratch(docs.sparkSession, "interpolation")
    rows = ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), fold_of(F.col("doc_id"), folds).alias("fold"), F.col("text").cast("binary").alias("text"))
    blocks = scratch.keep(rows.mapInArrow(_blocks(dev_fold), STATE))

    of = F.arrays_zip("folds", "sizes")
    taught = lambda keep: F.aggregate(F.filter(of, keep), F.lit(0).cast("long"), lambda n, x: n + x["sizes"])
    tokens, total, deleted_tokens = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum(taught(lambda x: x["folds"] != held_fold)), F.sum(taught(lambda x: x["folds"] == dev_fold))).first())
    parts = max(1, tokens * order // PART)
    sent = blocks.mapInArrow(_send(order, parts, held_fold), SENT)
    answers = scratch.keep(sent.groupBy("part").applyInArrow(_answer, ANSWERED))
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    answered = answers.select("block", "part", "n", "kept", "dev")

    def with_answers(some: DataFrame, work, schema: str) -> DataFrame:
        return some.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(work, schema)

    deleted = scratch.keep(with_answers(blocks.where("dev"), _deleted(order, total - deleted_tokens, vocabulary), "bucket binary, p binary"))
    weights = learned_weights(deleted, order, vocabulary)
    return with_answers(blocks, _scores(order, total, vocabulary, held_fold, weights), SCORED)
