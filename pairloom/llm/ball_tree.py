"""Hard negatives by branch and bound over ball trees.

Every vector is dealt to the list of its nearest centroid (fitted on a bounded sample, as in `ann`), every list to blocks of bounded size by a hash of its row, and each
block gets a ball tree: nodes with a centre and a radius, halved along the direction of widest spread down to leaves of LEAF vectors. A ball bounds the inner product with an
anchor a from both sides: a.centre +- |a| radius. Two searches go through the blocks:

* positives: the best rows of the anchor's label. A node is pruned when its upper bound is strictly beneath the k-th best so far.
* negatives: for each positive, the best rows of other labels whose score lies in a window of shares of the positive's score. A node is pruned when its
  bounds lie outside the window, or its upper bound is strictly beneath the k-th best so far.

The sample's rows are candidates themselves, so the k-th best of them is a floor to begin with, and anchors are sent only to lists whose ball can reach their floor. What remains is visited,
all of it: ties at the k-th score survive pruning and go to the smaller vec_id.

Components are floor(256 x), scores exact integers: products are taken in doubles where |a||b| is under 2^53, else in 64-bit integers. Rows with null vec_id, label, vector, or a
null or non-finite component take no part; neither do vectors of another length than the most frequent one, nor those of a squared integer norm over 2^62, whose scores might not fit
a long. Zero vectors take part. Repeated rows are candidates each; an id asks once, whatever its rows (where they differ, the smallest label, then vector), and its own
rows are no candidates for it. An empty table gives an empty result. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.ann import fit_centroids, lists_for, nearest_list
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

#: Vectors in a block on average, and in a leaf at most; components in the sample (about so many, drawn by a hash of vec_id); scores that are computed at once.
BLOCK, LEAF = 4_096, 64
SAMPLE_NUMBERS = 1 << 19
PAIRS = 1 << 20
_EXACT = 2.0**52

#: An anchor's windows are the scores between which rows are sought.
ASKED = "list int, block int, vec_id long, label int, v array<double>, low array<long>, high array<long>, floor array<long>"
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows."""
    most = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class BallTree:
    """Balls over rows of v, children of node i at 2i+1 and 2i+2. Rows are in leaf order: node i holds rows start[i] to end[i]."""

    def __init__(self, v: np.ndarray) -> None:
        self.order = np.arange(len(v))
        levels = max(0, int(np.ceil(np.log2(max(1, len(v)) / LEAF))))
        self.first_leaf = (1 << levels) - 1
        nodes = (2 << levels) - 1
        self.start, self.end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.centre, self.radius = np.zeros((nodes, v.shape[1])), np.zeros(nodes)
        self.end[0] = len(v)
        for i in range(nodes):
            own = self.order[self.start[i] : self.end[i]]
            if len(own):
                rows = v[own]
                self.centre[i] = rows.mean(0)
                away = np.sqrt(((rows - self.centre[i]) ** 2).sum(1))
                self.radius[i] = away.max() * (1 + 1e-9)
                if i < self.first_leaf:
                    along = rows @ (rows[away.argmax()] - self.centre[i])
                    self.order[self.start[i] : self.end[i]] = own[np.argpartition(along, len(own) // 2)] if len(own) > 1 else own
            if i < self.first_leaf:
                middle = (self.start[i] + self.end[i]) // 2
                self.start[2 * i + 1], self.end[2 * i + 1] = self.start[i], middle
                self.start[2 * i + 2], self.end[2 * i + 2] = middle, self.end[i]
        self.norm = np.sqrt((self.centre**2).sum(1))

    def bounds(self, q: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Between what the scores of queries with any row of the node lie, a rounding's width added."""
        size = np.sqrt((q * q).sum(1))
        about, half = q @ self.centre[node], size * self.radius[node] + 1e-12 * size * (self.norm[node] + self.radius[node]) + 1e-3
        return about - half, about + half


class Best:
    """The k best (score, id) found for each window, better ones first."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor.copy()
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.rows.append(np.stack([window, score, ids]))
        self.held += len(window)
        if self.held > max(1 << 14, 8 * self.k * len(self.floor)):
            self.settle()

    def settle(self) -> np.ndarray:
        """Rows (window, score, id) in order, the k best of each; raises the floors."""
        all_rows = np.concatenate(self.rows, axis=1) if self.rows else np.zeros((3, 0), np.int64)
        all_rows = all_rows[:, np.lexsort((all_rows[2], -all_rows[1], all_rows[0]))]
        first = np.flatnonzero(np.diff(all_rows[0], prepend=-1))
        rank = np.arange(all_rows.shape[1]) - np.repeat(first, np.diff(first, append=all_rows.shape[1]))
        last = all_rows[:, rank == self.k - 1]
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[1])
        self.rows, self.held = [all_rows[:, rank < self.k]], int((rank < self.k).sum())
        return self.rows[0]


def search_block(tree: BallTree, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Rows (window, score, id): for each window of each query (windows count row by row) the k best rows of the block in it, of the query's label or of others.

    v, ids and labels are in the tree's order. Nodes are taken best bound first, those that no query needs any more not at all."""
    best = Best(floor.ravel(), k)
    wide = low.shape[1]
    every = np.arange(len(q))

    def needed(node: int, among: np.ndarray) -> tuple[np.ndarray, float]:
        lower, upper = tree.bounds(q[among], node)
        least = np.maximum(low[among], best.floor.reshape(-1, wide)[among])
        wanted = ((upper[:, None] >= least) & (lower[:, None] <= high[among])).any(1)
        return among[wanted], float(upper[wanted].max(initial=-np.inf))

    waiting = [(0, every)]
    while waiting:
        node, among = waiting.pop()
        among, _ = needed(node, among)
        if not len(among) or tree.start[node] == tree.end[node]:
            continue
        if node < tree.first_leaf:
            halves = [(*needed(child, among), child) for child in (2 * node + 1, 2 * node + 2)]
            waiting += [(child, part) for part, _, child in sorted(halves, key=lambda h: h[1]) if len(part)]
            continue
        a, b = tree.start[node], tree.end[node]
        score = products(q[among], v[a:b])
        fits = (labels[a:b] == q_labels[among, None]) == same
        fits &= ids[a:b] != q_ids[among, None]
        least = np.maximum(low[among], best.floor.reshape(-1, wide)[among])
        for w in range(wide):
            i, j = np.nonzero(fits & (score >= least[:, w, None]) & (score <= high[among, w, None]))
            if len(i):
                best.add(among[i] * wide + w, score[i, j], ids[a:b][j])
        best.settle()
    return best.settle()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Lists:
    """What routing knows of the lists: centroids, radii and numbers of blocks; and the sample's rows."""

    def __init__(self, centroids: np.ndarray, stats: dict[int, tuple[int, float]], sample: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.centroids, self.sample, self.ids, self.labels = centroids, sample, ids, labels
        self.sizes = np.array([stats.get(i, (0, 0.0))[0] for i in range(len(centroids))])
        self.radius = np.array([stats.get(i, (0, 0.0))[1] for i in range(len(centroids))]) * (1 + 1e-9)
        self.blocks = np.maximum(1, -(-self.sizes // BLOCK))

    def floors(self, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> np.ndarray:
        """The k-th best score in each window among the sample; the lowest number where there are fewer."""
        out = np.full(low.shape, _LOWEST)
        if len(self.sample) < k:
            return out
        score = products(q, self.sample)
        fits = ((self.labels == q_labels[:, None]) == same) & (self.ids != q_ids[:, None])
        for w in range(low.shape[1]):
            inside = np.where(fits & (score >= low[:, w, None]) & (score <= high[:, w, None]), score, _LOWEST)
            out[:, w] = np.partition(inside, inside.shape[1] - k, axis=1)[:, inside.shape[1] - k]
        return out

    def visited(self, q: np.ndarray, least: np.ndarray, high: np.ndarray) -> np.ndarray:
        base, size = q @ self.centroids.T, np.sqrt((q * q).sum(1))[:, None]
        half = size * self.radius + 1e-12 * size * (np.sqrt((self.centroids**2).sum(1)) + self.radius) + 1e-3
        reach = ((base + half)[:, :, None] >= least[:, None, :]) & ((base - half)[:, :, None] <= high[:, None, :])
        return reach.any(2) & (self.sizes > 0)


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2))
            own = nearest_list(v, centroids)
            away = np.sqrt(((v - centroids[own]) ** 2).sum(1)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(away), *batch.columns], names=["list", "away", *batch.schema.names])

    return run


def _lists_of(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def _route(lists: Lists, k: int, same: bool):
    """Anchors (vec_id, label, v, low, high) to a row for each block of each list that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids, labels, q = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
                low, high = _windows(batch.column(3), _HIGHEST), _windows(batch.column(4), _LOWEST)
                floor = lists.floors(q, ids, labels, low, high, k, same)
                i, c = np.nonzero(lists.visited(q, np.maximum(low, floor), high))
                i, c = np.repeat(i, lists.blocks[c]), np.repeat(c, lists.blocks[c])
                first = np.flatnonzero(np.diff(i * len(lists.sizes) + c, prepend=-1))
                block = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
                sizes = np.array([len(x) for x in batch.column(3)], dtype=np.int64)
                floors = _lists_of([f[:n].tolist() for f, n in zip(floor, sizes)])
                where = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(block, pa.int32()), *(batch.column(x).take(where) for x in range(5)), floors.take(where)], names=["list", "block", "vec_id", "label", "v", "low", "high", "floor"])

    return run


def _windows(column: pa.Array, missing: int) -> np.ndarray:
    """Lists of numbers as a matrix, filled up with `missing`, which makes windows that hold nothing."""
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0) or 1), missing, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _search(k: int, same: bool):
    """Units come one after the other, each with its candidates (side 0) before its anchors (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree, own = None, [], None, None
        for batch in batches:
            units = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            side, ids, labels, v = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5))
            edges = np.flatnonzero((np.diff(units, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(units)]):
                if tuple(units[a]) != key:
                    key, parts, tree = tuple(units[a]), [], None
                split = a + int((side[a:b] == 0).sum())
                if split > a:
                    parts.append((v[a:split], ids[a:split], labels[a:split]))
                if split < b and tree is None and parts:
                    own = [np.concatenate(x) for x in zip(*parts)]
                    tree, parts = BallTree(own[0]), []
                    own = [x[tree.order] for x in own]
                for at in range(split, b, max(1, PAIRS // BLOCK)) if tree is not None else ():
                    to = min(b, at + max(1, PAIRS // BLOCK))
                    low, high, floor = (_windows(batch.column(x).slice(at, to - at), m) for x, m in ((6, _HIGHEST), (7, _LOWEST), (8, _HIGHEST)))
                    window, score, found = search_block(tree, *own, v[at:to], ids[at:to], labels[at:to], low, high, floor, k, same)
                    if len(window):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][window // low.shape[1]]), pa.array((window % low.shape[1]).astype(np.int32)), pa.array(score), pa.array(found)], names=["anchor_id", "window", "score", "vec_id"])

    return run


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id long, label int, v array<double> of integers) of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    usual = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    small = F.aggregate("v", F.lit(0.0), lambda n, x: n + 65536 * x * x + 1) < 2.0**61
    return rows.where(F.size("v") == (usual or 0)).where(small).withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))


class Index:
    """Rows (vec_id, label, v) dealt to lists and blocks."""

    def __init__(self, rows: DataFrame, scratch: Scratch, seed: int = 5) -> None:
        n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        most = max(256, SAMPLE_NUMBERS // (d or 1))
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
        sample = rows.where(drawn < int(min(1.0, most / max(1, n)) * (1 << 30))).limit(2 * most).collect()
        points = np.array([r.v for r in sample], dtype=np.float64).reshape(len(sample), -1) if sample else np.zeros((0, d or 1))
        centroids = fit_centroids(points, lists_for(n), seed)
        self.scratch = scratch
        self.placed = scratch.keep(rows.mapInArrow(_assign(centroids), "list int, away double, vec_id long, label int, v array<double>").withColumn("row", F.monotonically_increasing_id()))
        stats = {r["list"]: (r["n"], r["away"]) for r in self.placed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
        self.lists = Lists(centroids, stats, points, np.array([r.vec_id for r in sample], dtype=np.int64), np.array([r.label for r in sample], dtype=np.int64))

    def best(self, asking: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_id, window (from 0), rank (from 1), vec_id, score: the k best rows in each window of anchors (vec_id, label, v, low, high)."""
        of_list = F.element_at(F.array(*map(F.lit, self.lists.blocks.tolist())), F.col("list") + 1)
        none = F.array().cast("array<long>")
        held = self.placed.select("list", F.pmod(F.xxhash64("row"), of_list).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "label", "v", none.alias("low"), none.alias("high"), none.alias("floor"))
        asked = asking.select("vec_id", "label", "v", "low", "high").mapInArrow(_route(self.lists, k, same), ASKED).select("list", "block", F.lit(1).alias("side"), "vec_id", "label", "v", "low", "high", "floor")
        units = held.union(asked).repartition("list", "block").sortWithinPartitions("list", "block", "side", "vec_id")
        found = units.mapInArrow(_search(k, same), "anchor_id long, window int, score long, vec_id long")
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's best rows of its label the best rows of other labels that score `low` to `high` hundredths of it.

    anchors: a condition on vec_id; label: an expression over the table's columns in place of label."""
    scratch = Scratch(embeddings.sparkSession, "negatives")
    index = Index(usable(ship(embeddings), F.col("label") if label is None else label), scratch)
    asking = scratch.keep(index.placed.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"))
    every = asking.withColumn("low", F.array(F.lit(_LOWEST))).withColumn("high", F.array(F.lit(_HIGHEST)))
    near = scratch.keep(index.best(every, positives, True).select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # shares of a score in whole numbers, split at the hundreds so that nothing overflows
    whole, rest = F.expr("div(positive_score - pmod(positive_score, 100), 100)"), F.pmod("positive_score", F.lit(100))
    least, most = whole * low + F.ceil(rest * low / 100), whole * high + F.floor(rest * high / 100)
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", least.cast("long").alias("low"), most.cast("long").alias("high")))).alias("w"))
    second = asking.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = index.best(second, negatives, False).select("anchor_id", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
