"""Approximate nearest neighbours by randomly rotated one-bit codes (RaBitQ, Gao and Long, 2024).

Vectors are dealt to lists around centroids fitted on a bounded sample. In its list a vector is kept as the signs of its
rotated residual, packed into bytes, with two correction scalars: the residual's norm and the inner product of the unit
residual with its code. For a block of queries the codes estimate every inner product of a list at once; the error bound tells
which vectors can still be among the nearest, and those are reranked exactly, in double precision.

The sample's vectors are candidates themselves, so the (k + SPARE)-th best of them is a floor under each query's k-th best; the spare ones make up
for what the error bounds of codes may lose. It prunes twice: a query skips lists whose bound (its product with the centroid, and its norm times the
largest norm of a residual) is under its floor, and in a list the vectors whose estimate and error bound stay under it.
Clustered vectors so need few lists; vectors without clusters need all, as any of their lists can hold a near one.

Every vector is indexed. The vectors of a list are split into blocks of bounded size by a hash of their row, so a list with a third of all
vectors (or of copies of one vector) is many units of work. Queries stream through a unit a batch at a time; what a query sends to a unit is its vector.

Vectors null, of another length than the most frequent one (the longer of equally frequent ones), zero, or holding null or non-finite
components take no part, neither do null ids. Repeated rows count as candidates each. An id asks once, whatever its rows; where they differ, the
smallest vector asks; rows of its own id are no candidates of a query. Ties go to the smaller vec_id. An empty table gives an empty
result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

#: The sample for centroids and floors (drawn by a hash of vec_id, about so many components, twice as many at most), and the number of centroids at most.
SAMPLE_NUMBERS, MOST_LISTS = 1 << 20, 2_048
#: Vectors in a unit of work, on average.
BLOCK = 4_096
#: Half-width of the error bound of an estimate, in standard deviations; ranks by which floors lie under the k-th best of the sample.
BOUND, SPARE = 3.5, 16
#: Pairs of a query and a vector that are estimated at once.
PAIRS = 1 << 20

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def lists_for(rows: int) -> int:
    return int(min(MOST_LISTS, max(1, -(-rows // BLOCK))))


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on the bounded sample, a block of it at a time."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_list(sample, c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_list(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half, step = (centroids * centroids).sum(1) / 2, max(1, PAIRS // len(centroids))
    parts = [(v[i : i + step] @ centroids.T - half).argmax(1) for i in range(0, len(v), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Codes:
    """One-bit codes of a block of vectors against its list's centroid."""

    def __init__(self, vectors: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> None:
        self.d = vectors.shape[1]
        residual = (vectors - centroid) @ turn
        self.norm = np.linalg.norm(residual, axis=1)
        unit = residual / np.maximum(self.norm, 1e-300)[:, None]
        self.fit = np.maximum(np.abs(unit).sum(1) / math.sqrt(self.d), 1e-12)
        self.bits = np.packbits(residual > 0, axis=1)
        self.spread = self.norm * np.sqrt(np.maximum(0, 1 / self.fit**2 - 1) / max(1, self.d - 1))

    def estimate(self, base: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of queries (rows; base their products with the centroid) with all vectors, and the half-widths of their bounds."""
        ones = np.unpackbits(self.bits, axis=1, count=self.d).astype(np.float32)
        signed = 2 * (turned.astype(np.float32) @ ones.T) - turned.sum(1, dtype=np.float32)[:, None]
        about = base[:, None] + signed * (self.norm / self.fit / math.sqrt(self.d)).astype(np.float32)
        return about, np.linalg.norm(turned, axis=1)[:, None] * (BOUND * self.spread).astype(np.float32)


def nearest_in_block(codes: Codes, ids: np.ndarray, vectors: np.ndarray, centroid: np.ndarray, turn: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the exact scores of the k best vectors of the block that the bounds and its floor leave, without rows of the query's own id."""
    step = max(1, PAIRS // max(1, len(ids)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        about, half = codes.estimate(q @ centroid, q @ turn)
        likely = about + half >= floors[at : at + step, None]
        for i in range(len(q)):
            found = np.flatnonzero(likely[i])
            found = found[ids[found] != query_ids[at + i]]
            score = (vectors[found] * q[i]).sum(1)
            found, score = found[score >= floors[at + i]], score[score >= floors[at + i]]
            if len(found) > k:
                best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                found, score = found[best], score[best]
            best = np.lexsort((ids[found], -score))[:k]
            if len(best):
                yield int(query_ids[at + i]), ids[found][best], score[best]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Lists:
    """What routing knows of the lists: centroids, numbers of vectors and blocks, largest norms of the residuals; and the sample."""

    def __init__(self, centroids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, stats: dict[int, tuple[int, float]]) -> None:
        self.centroids, self.sample, self.sample_ids = centroids, sample, sample_ids
        self.sizes = np.array([stats.get(i, (0, 0.0))[0] for i in range(len(centroids))])
        self.radius = np.array([stats.get(i, (0, 0.0))[1] for i in range(len(centroids))])
        self.blocks = np.maximum(1, -(-self.sizes // BLOCK))

    def floors(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The (k + SPARE)-th best score of each query among the sample (less a rounding's width), without its own id."""
        k = min(k + SPARE, len(self.sample))
        score = np.where(self.sample_ids[None, :] == ids[:, None], -np.inf, q @ self.sample.T)
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if k else np.full(len(q), -np.inf)
        return np.where(np.isinf(kth), -np.inf, kth - 1e-9 * np.abs(kth))

    def visited(self, q: np.ndarray, floors: np.ndarray, share: float) -> np.ndarray:
        """Which lists each query visits: those whose bound reaches its floor, the given share of all lists at most."""
        base = q @ self.centroids.T
        visit = (base + np.linalg.norm(q, axis=1)[:, None] * self.radius >= floors[:, None]) & (self.sizes > 0)
        if share < 1:
            rank = np.argsort(np.argsort(-base, axis=1, kind="stable"), axis=1)
            visit &= rank < math.ceil(share * len(self.centroids))
        return visit


def _route(lists: Lists, k: int, share: float):
    """Rows (list, block, query_id, v, floor) for the lists that each query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1))
                floors = lists.floors(ids, q, k)
                i, c = np.nonzero(lists.visited(q, floors, share))
                i, c = np.repeat(i, lists.blocks[c]), np.repeat(c, lists.blocks[c])
                first = np.flatnonzero(np.diff(i * len(lists.sizes) + c, prepend=-1))
                block = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
                where = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(block, pa.int32()), batch.column(0).take(where), batch.column(1).take(where), pa.array(floors[i])], names=["list", "block", "vec_id", "v", "floor"])

    return run


def _search(centroids: np.ndarray, turn: np.ndarray, k: int):
    """Units come one after the other, each with its candidates (side 0) before its queries (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, codes, ids, vectors = None, [], None, None, None
        for batch in batches:
            units = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            side, own, v, floors = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4)), batch.column(5).to_numpy()
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            edges = np.flatnonzero((np.diff(units, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(units)]):
                if tuple(units[a]) != key:
                    key, parts, codes = tuple(units[a]), [], None
                split = a + int((side[a:b] == 0).sum())
                if split > a:
                    parts.append((own[a:split], v[a:split]))
                if split < b and codes is None and parts:
                    ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    codes, parts = Codes(vectors, centroids[key[0]], turn), []
                if split < b and codes is not None:
                    found += nearest_in_block(codes, ids, vectors, centroids[key[0]], turn, own[split:b], v[split:b], floors[split:b], k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], schema=OUT)

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            own = nearest_list(v, centroids)
            away = np.linalg.norm(v - centroids[own], axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(away), batch.column(0), batch.column(1)], names=["list", "away", "vec_id", "v"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    usual = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    return rows.where(F.size("v") == (usual or 0))


def nearest(embeddings: DataFrame, queries: Column, k: int = 20, seed: int = 5, share: float = 1.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by inner product for the ids where `queries` (a condition on vec_id) holds.

    With a share under 1 a query visits no more than that share of the lists, those of the nearest centroids."""
    scratch = Scratch(embeddings.sparkSession, "nearest")
    rows = usable(ship(embeddings))
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    drawn, most = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)), max(k + 1, SAMPLE_NUMBERS // (d or 1))
    sample = rows.where(drawn < int(min(1.0, most / max(1, n)) * (1 << 30))).limit(2 * most).collect()
    points = np.array([r.v for r in sample], dtype=np.float64) if sample else np.zeros((0, d or 1))
    centroids, turn = fit_centroids(points, lists_for(n), seed), rotation(points.shape[1], seed)
    placed = scratch.keep(rows.mapInArrow(_assign(centroids), "list int, away double, vec_id long, v array<double>").withColumn("row", F.monotonically_increasing_id()))
    stats = {r["list"]: (r["n"], r["away"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    lists = Lists(centroids, points, np.array([r.vec_id for r in sample], dtype=np.int64), stats)
    of_list = F.element_at(F.array(*map(F.lit, lists.blocks.tolist())), F.col("list") + 1)
    held = placed.select("list", F.pmod(F.xxhash64("row"), of_list).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "v", F.lit(0.0).alias("floor"))
    asking = placed.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asking.mapInArrow(_route(lists, k, share), "list int, block int, vec_id long, v array<double>, floor double").select("list", "block", F.lit(1).alias("side"), "vec_id", "v", "floor")
    found = held.union(asked).repartition("list", "block").sortWithinPartitions("list", "block", "side", "vec_id").mapInArrow(_search(centroids, turn, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
