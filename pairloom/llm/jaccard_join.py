"""N-gram Jaccard join: count vectors in an R-tree bound the overlap, surviving pairs are verified exactly.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of k-word shingles (64-bit values).

1. Rows with equal sets form a class; the rest of the work has one row of each, which its row number names.
2. Where a class can meet a partner: both hash their shingles into the m groups of a size scheme. A partner's set
   differs in at most K(n) shingles, so of the first K(n) + 1 + 2 * slack groups at least 1 + 2 * slack hold the same
   shingles. A class offers the digest of every such group; up to `slack` empty groups aren't offered, which leaves
   1 + drop shared digests. Every class leaves out its `drop` most held digests (of those in its scheme; common
   passages, that is), in one order for all, so the least held digest that a pair shares is kept by both.
   Classes that still share a digest meet with their count vectors (equal meetings once): those whose bound reaches
   the overlap needed are tied. The holders of a heavy digest are dealt into blocks first, and every two blocks meet, so
   no unit is larger than two blocks. Ties make candidate groups (connected components).
   Digests that hold more than a quarter of a partition are found in a sample of the classes first; there are at most four a
   partition. They are summed where they lie and what they sum to is broadcast, so no task gets all holders of a digest.
3. Each candidate group is one unit of work: group counts of the shingles are points in an R-tree; a node or point is
   left out where the summed coordinate minima fall short of the overlap that its size needs; survivors that are
   not connected yet are verified on the whole sets. A candidate group over the weight limit is dealt into blocks that
   share a pivot; what stays apart from the group's largest component then meets every block. That covers all pairs.

Nulls: null or empty text, or text without words, is an empty set linked with nothing (its own component). Every row is a document of its
own: rows that share a doc_id are each compared by their own text, repeated rows are copies. A row with a null doc_id links like others and
gets a null component. Ties go to the smallest doc_id. Very long texts are compared whole.
An empty table gives an empty result. Only `doc_id` and `text` are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.sieve import sieve
from pairloom.llm.words import finish, shingle_set
from pairloom.operators.components import connected_components
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

#: Coordinates of a count vector in the tree, of the finer one that survivors are held against, and entries of an R-tree node.
DIMS, FINE, FANOUT = 64, 1024, 16
#: Bounds that are computed at once; points of a leaf where whole meetings are compared; ones that a point may take in a product.
CHUNK, LEAF, ONES = 16_384, 128, 6_144
#: Coordinates of the points that meet at a digest, by the most shingles of a set. A longer point folds into a shorter one.
POINTS = {192: 64, 400: 128, 1600: 256, 5000: 512, 1 << 62: 2048}
#: Coordinates in which whole meetings are compared first.
FIRST_POINT = 256
#: A scheme's slack is the most that may differ by this, and 1.
SLACK = 3
#: A digest that more classes hold has its holders dealt into blocks of so many, which meet two by two.
HEAVY = 4096
#: A unit of work: members, and shingles in all their sets.
UNIT_MEMBERS, UNIT_SHINGLES = 4096, 6_000_000
#: One class in so many is in the sample that finds hot digests.
SAMPLE = 16


def spread(n: int, percent: int) -> int:
    """Most shingles in which a linked partner of a set of n can differ (symmetric difference)."""
    return n * (100 - percent) // percent


def schemes(n: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(place, scheme, groups, slack) in which a set of n takes part: its own size band's, and the next one's if a partner can be there.

    Bands grow by 100/percent at least, so linked sizes are in one band or in neighbouring ones.
    """
    if spread(n, percent) == 0:
        return []
    low, out = 1, []
    for place in count():
        high = max(low + 1, -(-low * 100 // percent)) if low < 256 else 2 * low
        if low <= n < high or (n < low and n * 100 >= low * percent):
            slack = 1 + spread(-(-low * percent // 100), percent) // SLACK
            out.append((place, low, spread(high - 1, percent) + 1 + 2 * slack, slack))
        if n < low and not n * 100 >= low * percent:
            return out
        low = high


def digests(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """What a set offers as meeting places, and how many it may leave out in the schemes of even and of odd place.

    The lowest bit of a digest is the parity of its scheme's place; the at most two schemes of a set are neighbours.
    """
    n, parts, drop = len(s), [], [0, 0]
    for place, scheme, m, slack in schemes(n, percent):
        use = min(m, spread(n, percent) + 1 + 2 * slack)
        group = (s >> np.uint64(5)) % np.uint64(m)
        inside = group < use
        g = group[inside].astype(np.int64)
        total = np.zeros(use, dtype=np.uint64)
        np.add.at(total, g, finish(s[inside] ^ np.uint64(0xA5A5A5A5DEADBEEF)))
        held = np.bincount(g, minlength=use)
        keys = finish(total + finish(np.arange(use, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme * 2 + 1)))
        keys = keys & ~np.uint64(1) | np.uint64(place % 2)
        empty = int((held == 0).sum())
        parts.append(keys[held > 0] if empty <= slack else keys)
        drop[place % 2] = 2 * slack - min(empty, slack)
    return (np.concatenate(parts) if parts else s[:0]), drop


def point(s: np.ndarray) -> bytes:
    """A set's group counts, each a byte rounded up to a multiple of the scale that follows them, so bounds stay bounds."""
    dims = next(d for most, d in POINTS.items() if len(s) <= most)
    counts = np.bincount((s >> np.uint64(17)).astype(np.int64) % dims, minlength=dims)
    scale = max(1, -(-int(counts.max()) // 255))
    return (-(-counts // scale)).astype(np.uint8).tobytes() + scale.to_bytes(4, "little")


def counts_of(points: list[bytes], dims: int) -> np.ndarray:
    """The counts in the given coordinates, longer points folded; points of fewer coordinates are zero rows."""
    out = np.zeros((len(points), dims), np.int32)
    length = np.fromiter(map(len, points), np.int64, len(points)) - 4
    for own in POINTS.values():
        at = np.flatnonzero(length == own)
        if own >= dims and len(at):
            raw = np.frombuffer(b"".join([points[i] for i in at]), np.uint8).reshape(len(at), own + 4)
            scaled = raw[:, :own].astype(np.int32) * np.ascontiguousarray(raw[:, own:]).view("<u4").astype(np.int32)
            out[at] = scaled.reshape(len(at), own // dims, dims).sum(1)
    return out


def _profile(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                n, first, second, drops, offered, points = [], [], [], [], [], []
                for text in batch.column(3).slice(at, 512):
                    s = shingle_set(text.as_py(), k)
                    keys, drop = digests(s, percent)
                    n.append(len(s))
                    first.append(int(finish(s).sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(np.bitwise_xor.reduce(finish(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(11))).view(np.int64)) if len(s) else 0)
                    drops.append(drop)
                    offered.append(keys.view(np.int64))
                    points.append(point(s))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in offered])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(offered)))
                own = [batch.column(i).slice(at, 512) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array([x for x, _ in drops], pa.int32()), pa.array([x for _, x in drops], pa.int32()), lists, pa.array(points, pa.binary())], names=["doc_id", "k1", "k2", "n", "f1", "f2", "even", "odd", "keys", "point"])

    return run


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """A packed R-tree over count vectors: the points lie in order of size and leading counts, nodes keep maxima and size ranges."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = []
        high, low, top = self.counts, self.sizes, self.sizes
        while len(high) > FANOUT or not self.levels:
            starts = np.arange(0, len(high), FANOUT)
            high, low, top = np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(top, starts)
            self.levels.append((high, low, top))

    def search(self, asks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asking position, found position, bound) in tree order, by asking position, of the points whose bound reaches the overlap needed.

        All that ask go down the tree together, a level at a time."""
        size = self.sizes[asks]
        least, most = -(-size * percent // 100), size * 100 // percent
        ask, at = (x.ravel() for x in np.meshgrid(np.arange(len(asks)), np.arange(len(self.levels[-1][0])), indexing="ij"))
        for i, (high, low, top) in enumerate(reversed(self.levels)):
            fits = (low[at] <= most[ask]) & (top[at] >= least[ask])
            ask, at = ask[fits], at[fits]
            sure = self._bound(high, at, asks[ask]) >= needed(size[ask], np.maximum(low[at], least[ask]), percent)
            ask, at = np.repeat(ask[sure], FANOUT), (at[sure][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            inside = at < (len(self.counts) if i == len(self.levels) - 1 else len(self.levels[-2 - i][0]))
            ask, at = ask[inside], at[inside]
        bound = self._bound(self.counts, at, asks[ask])
        sure = bound >= needed(size[ask], self.sizes[at], percent)
        return asks[ask[sure]], at[sure], bound[sure]

    def _bound(self, high: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        parts = [np.minimum(high[at[i : i + CHUNK]], self.counts[own[i : i + CHUNK]]).sum(1, dtype=np.int32) for i in range(0, len(at), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def link_unit(ids: list[int], labels: list[int], probe: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect, with the given labels, whatever the links between a probe and any member connect."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    counts = np.stack([np.bincount((s >> np.uint64(17)).astype(np.int64) % DIMS, minlength=DIMS) for s in sets]).astype(np.int32)
    tree = CountTree(counts, sizes)
    fine = np.stack([np.bincount((s >> np.uint64(23)).astype(np.int64) % FINE, minlength=FINE) for s in sets]).astype(np.int16 if sizes.max() < 1 << 15 else np.int32)
    asks = np.array(probe)[tree.order]
    group = np.unique(np.array(labels), return_inverse=True)[1][tree.order]
    edges = []
    for i in np.flatnonzero(asks):
        own = tree.order[i]
        _, at, bound = tree.search(np.array([i]), percent)
        at, bound = (x[(group[at] != group[i]) & ((at >= i) | ~asks[at])] for x in (at, bound))
        closer = np.minimum(fine[tree.order[at]], fine[own]).sum(1, dtype=np.int64) >= needed(int(sizes[own]), sizes[tree.order[at]], percent)
        for j in at[closer][np.argsort(-bound[closer], kind="stable")]:
            if group[j] == group[i]:
                continue
            other = tree.order[j]
            if len(np.intersect1d(sets[own], sets[other], assume_unique=True)) >= needed(int(sizes[own]), int(sizes[other]), percent):
                edges.append((ids[own], ids[other]))
                group[group == group[j]] = group[i]
    return edges


def _bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of all rows of a with all of b. A count is as many ones as it says, so a matrix product sums the minima."""
    top = int(min(a.max(), b.max()))
    if top * a.shape[1] <= ONES:
        levels = np.arange(top)
        x, y = ((c[:, :, None] > levels).reshape(len(c), -1).astype(np.float32) for c in (a, b))
        return (x @ y.T).astype(np.int32)
    return np.stack([np.minimum(b, row).sum(1, dtype=np.int32) for row in a]) if len(a) else np.zeros((0, len(b)), np.int32)


def _reaches(counts: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima of rows a and b reach the overlap needed, pair by pair."""
    step = max(1, CHUNK * 64 // counts.shape[1])
    parts = [np.minimum(counts[a[i : i + step]], counts[b[i : i + step]]).sum(1) >= need[i : i + step] for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def tie_unit(ids: np.ndarray, n: np.ndarray, points: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the pairs whose bound reaches the overlap needed connect.

    The tree's leaves meet: two of them are left out by their maxima and sizes, or where all their points are connected already. Leaves nearest the
    middle come first, as what is alike is mostly there."""
    dims = min(len(p) for p in points) - 4
    counts, n = counts_of(points, min(dims, FIRST_POINT)), n.astype(np.int64)
    order = np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], n))
    ids, n, counts = ids[order], n[order], counts[order]
    fine = counts_of(points, dims)[order] if dims > FIRST_POINT else None
    starts = np.arange(0, len(ids), LEAF)
    leaves = [slice(i, i + LEAF) for i in starts]
    high, low, top = np.maximum.reduceat(counts, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    group, edges, middle = np.arange(len(ids)), [], len(leaves) // 2
    for i in sorted(range(len(leaves)), key=lambda i: abs(i - middle)):
        least = np.maximum(low, -(-low[i] * percent // 100))
        sure = np.minimum(high, high[i]).sum(1) >= needed(low[i], least, percent)
        for j in np.flatnonzero(sure & (100 * top >= percent * low[i]) & (100 * top[i] >= percent * low)):
            x, y = leaves[i], leaves[j]
            if i == j or abs(j - middle) > abs(i - middle) or (abs(j - middle) == abs(i - middle) and j > i):
                if i != j and len(np.unique(np.concatenate([group[x], group[y]]))) == 1:
                    continue
                own, other = n[x][:, None], n[y][None, :]
                reached = (_bounds(counts[x], counts[y]) >= needed(own, other, percent)) & (100 * np.minimum(own, other) >= percent * np.maximum(own, other))
                u, v = np.nonzero(reached & (group[x][:, None] != group[y][None, :]))
                u, v = u + starts[i], v + starts[j]
                if fine is not None:
                    closer = _reaches(fine, u, v, needed(n[u], n[v], percent))
                    u, v = u[closer], v[closer]
                for u, v in zip(u, v):
                    if group[u] != group[v]:
                        edges.append((int(ids[u]), int(ids[v])))
                        group[group == group[v]] = group[u]
    return edges


def small_ties(starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: np.ndarray, points: list[bytes], percent: int) -> list[tuple[int, int]]:
    """As tie_unit for many small groups at once (a leaf of the tree each): edges that connect what their pairs connect."""
    if not len(starts):
        return []
    length = np.fromiter(map(len, points), np.int64, len(points)) - 4
    tables = []
    for dims in POINTS.values():
        own = np.flatnonzero(length >= dims)
        place = np.full(len(points), -1)
        place[own] = np.arange(len(own))
        tables.append((place, counts_of([points[i] for i in own], dims)))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    edges = []
    for size in np.unique(ends - starts):
        rows = starts[ends - starts == size][:, None] + np.arange(size)
        left, right = np.triu_indices(size, 1)
        a, b = rows[:, left].ravel(), rows[:, right].ravel()
        likely = np.flatnonzero(100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        for at in range(0, len(likely), CHUNK):
            x, y = a[likely[at : at + CHUNK]], b[likely[at : at + CHUNK]]
            need = needed(n[x], n[y], percent)
            for place, counts in tables:
                both = np.flatnonzero((place[x] >= 0) & (place[y] >= 0))
                short = both[~_reaches(counts, place[x[both]], place[y[both]], need[both])]
                x, y, need = np.delete(x, short), np.delete(y, short), np.delete(need, short)
            for u, v in zip(ids[x].tolist(), ids[y].tolist()):
                if (p := root(u)) != (q := root(v)):
                    parent[p] = q
                    edges.append((u, v))
    return edges


def _tie(percent: int):
    """Meetings come one after the other; those that a batch cuts wait for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["held", "head", "mark", "node", "n"]
        held: dict[str, np.ndarray] = {c: np.zeros(0, np.int64) for c in names}
        waiting: list[bytes] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held = {c: np.concatenate([held[c], batch.column(i).to_numpy().astype(np.int64)]) for i, c in enumerate(names)}
                waiting += batch.column(5).to_pylist()
            meeting = np.stack([held[c] for c in names[:3]], 1)
            edge = np.flatnonzero((np.diff(meeting, axis=0) != 0).any(1)) + 1
            bounds = np.concatenate([[0], edge, [len(meeting)]]).astype(np.int64)
            whole = bounds if batch is None else bounds[:-1]
            starts, ends = whole[:-1], whole[1:]
            small = (ends - starts <= FANOUT) & (ends - starts > 1)
            edges = small_ties(starts[small], ends[small], held["node"], held["n"], waiting, percent)
            for s, e in zip(starts[ends - starts > FANOUT], ends[ends - starts > FANOUT]):
                edges += tie_unit(held["node"][s:e], held["n"][s:e], waiting[s:e], percent)
            held, waiting = {c: x[whole[-1] :] for c, x in held.items()}, waiting[whole[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([x for _, x in edges], pa.int64())], names=["a", "b"])

    return run


def _link(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def close() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            ids = list(held)
            edges = link_unit(ids, [held[x][0] for x in ids], [held[x][1] for x in ids], [held[x][2] for x in ids], percent)
            return pa.RecordBatch.from_pydict({"a": [x for x, _ in edges], "b": [x for _, x in edges]}, pa.schema([("a", pa.int64()), ("b", pa.int64())])) if edges else None

        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(batch.num_columns))):
                unit = tuple(x.as_py() for x in row[:3])
                if unit != key:
                    if (out := close()) is not None:
                        yield out
                    key, held = unit, {}
                node, label, probe = (x.as_py() for x in row[3:6])
                if node in held:
                    held[node] = (held[node][0], held[node][1] or probe, held[node][2])
                else:
                    held[node] = (label, probe, shingle_set(row[6].as_py(), k))
        if (out := close()) is not None:
            yield out

    return run


def _units(members: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges from members (comp, i, j, node, label, probe), one unit of work for each comp, i, j; each class with the text of its first row."""
    own = members.join(classes.select("node", "k1", "k2"), "node")
    rows = own.join(sieve(texts, "k1", own)[1], ["k1", "k2"]).select("comp", "i", "j", "node", "label", "probe", "text")
    return rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node").mapInArrow(_link(k, percent), "a long, b long")


def _by_key(rows: DataFrame, hot: DataFrame, **sums: Column) -> DataFrame:
    """rows with sums over their key. Keys in `hot` are summed before anything is shuffled, and their sums broadcast; without such keys the rows are read once, not three times."""
    over = Window.partitionBy("key")
    if hot.isEmpty():
        return rows.withColumns({name: c.over(over) for name, c in sums.items()})
    many = rows.join(F.broadcast(hot), "key", "left_semi")
    found = many.groupBy("key").agg(*(c.alias(name) for name, c in sums.items()))
    few = rows.join(F.broadcast(hot), "key", "left_anti").withColumns({name: c.over(over) for name, c in sums.items()})
    return few.unionByName(many.join(F.broadcast(found), "key"))


def _hot_keys(offered: DataFrame, scratch: Scratch) -> DataFrame:
    """Keys that hold more than about a quarter of a partition: those with that share of a sample of the classes, so at most four a partition."""
    sample = offered.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLE)) == 0).groupBy("key").count()
    partitions = int(offered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = scratch.keep(sample.where("count > 1"))
    share = (sample.agg(F.sum("count")).first()[0] or 0) / (4 * partitions)
    return scratch.keep(counted.where(F.col("count") > max(1.0, share)).select("key").limit(4 * partitions))


def _in_blocks(shared: DataFrame, heavy: int) -> DataFrame:
    """Meetings (node, held, head, mark) of at most about two times `heavy` classes: a larger one's holders are dealt into blocks, and each block meets every
    other one under a mark of the two, so every two holders meet."""
    many = shared.where(F.col("held") > heavy).withColumn("_blocks", F.ceil(F.col("held") / heavy).cast("int"))
    dealt = many.withColumn("_own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)"))).where("_own <> _other")
    parted = dealt.withColumn("mark", F.xxhash64("mark", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return shared.where(F.col("held") <= heavy).unionByName(parted.select(*shared.columns))


def _classified(docs: DataFrame, k: int, percent: int, heavy: int, unit_members: int, unit_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n, f1, f2, row of every row; n, f1, f2, class_id, node, comp of every class)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = _keyed(ship(docs).select("doc_id", F.col("text").cast("binary").alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = scratch.keep(texts.select("doc_id", "k1", "k2", "text").mapInArrow(_profile(k, percent), f"doc_id {kind}, k1 long, k2 long, n int, f1 long, f2 long, even int, odd int, keys array<long>, point binary").withColumn("row", F.monotonically_increasing_id()))
    profiles, same = scratch.keep(wide.select("doc_id", "k1", "k2", "n", "f1", "f2", "row")), ["n", "f1", "f2"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "k1", "k2")).alias("x")
    classes = scratch.keep(profiles.where("n > 0").groupBy(*same).agg(least).select(*same, F.col("x.doc_id").alias("class_id"), F.col("x.row").alias("node"), "x.k1", "x.k2"))
    others = scratch.keep(profiles.where("n > 0").join(classes.select(*same, "node"), same).where("row <> node").select("row"))
    offering = wide.where("n > 0").withColumn("at", F.xxhash64("row"))
    sure, perhaps = sieve(offering, "at", others.select(F.xxhash64("row").alias("at")))
    firsts = sure.unionByName(perhaps.join(others, "row", "left_anti")).withColumnRenamed("row", "node")

    odd = F.col("key").bitwiseAND(1)
    offered = firsts.where("size(keys) > 0").select("node", "even", "odd", F.explode("keys").alias("key")).select("node", "key", F.when(odd == 1, F.col("odd")).otherwise(F.col("even")).alias("drop"))
    hot = _hot_keys(offered, scratch)
    held = _by_key(offered, hot, held=F.count("*")).where("held > 1")
    kept = scratch.keep(held.withColumn("place", F.row_number().over(Window.partitionBy("node", odd).orderBy(F.desc("held"), "key"))).where("place > drop").select("node", "key"))
    met = _by_key(kept, hot, head=F.min("node"), held=F.count("*"), mark=F.bit_xor(F.xxhash64("node"))).where("held > 1")
    shared = scratch.keep(met.select("node", "head", "held", "mark").distinct())
    scratch.drop(kept)
    meeting = ["held", "head", "mark"]
    points = scratch.keep(firsts.select("node", "n", "point").join(shared.select("node").distinct(), "node", "left_semi"))
    scratch.drop(wide)
    meetings = _in_blocks(shared, heavy).join(points, "node")
    near = meetings.select(*meeting, "node", "n", "point").repartition(*meeting).sortWithinPartitions(*meeting).mapInArrow(_tie(percent), "a long, b long")
    ties = scratch.keep(near)
    for table in (shared, points):
        scratch.drop(table)
    candidates = scratch.keep(connected_components(ties, "a", "b").select("node", F.col("component").alias("comp")))

    weights = candidates.join(classes.select("node", "n"), "node").groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = scratch.keep(weights.select("comp", F.ceil(F.greatest(F.col("members") / unit_members, F.col("shingles") / unit_shingles)).cast("int").alias("blocks")))
    placed = candidates.join(blocks, "comp").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pivots = placed.where("blocks > 1 and node = comp").select("comp", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), "node")
    first = placed.select("comp", "i", "node").union(pivots).select("comp", "i", F.lit(-1).alias("j"), "node", F.col("node").alias("label"), F.lit(True).alias("probe"))
    edges = scratch.keep(_units(first, classes, texts, k, percent))
    found = connected_components(edges, "a", "b")
    if blocks.where("blocks > 1").head(1):
        hot = scratch.keep(placed.where("blocks > 1").join(found, "node", "left").select("comp", "blocks", "i", "node", F.coalesce("component", "node").alias("label")))
        largest = hot.groupBy("comp", "label").count().groupBy("comp").agg(F.max(F.struct("count", "label")).alias("top")).select("comp", F.col("top.label").alias("largest"))
        apart = hot.join(largest, "comp").where("label <> largest")
        split = apart.groupBy("comp").count().select("comp", F.ceil(F.col("count") / unit_members).cast("int").alias("probes"))
        probes = apart.join(split, "comp").select("comp", F.pmod(F.xxhash64("node", F.lit(1)), F.col("probes")).cast("int").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), "node", "label", F.lit(True).alias("probe"))
        rest = hot.join(split, "comp").select("comp", F.explode(F.expr("sequence(0, probes - 1)")).alias("x"), F.col("i").alias("j"), "node", "label", F.lit(False).alias("probe")).withColumnRenamed("x", "i")
        more = scratch.keep(_units(probes.unionByName(rest), classes, texts, k, percent))
        found = connected_components(edges.union(more), "a", "b")
    return profiles, classes.join(found, "node", "left").select(*same, "class_id", "node", F.coalesce("component", "node").alias("comp"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With two hashes of doc_id and text, which tell the rows apart that differ in one of them."""
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, heavy: int = HEAVY, unit_members: int = UNIT_MEMBERS, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """doc_id, n_shingles long, class_id (smallest doc_id with the same set), component_id (smallest reachable doc_id), a row per document."""
    profiles, classes = _classified(docs, k, percent, heavy, unit_members, unit_shingles)
    least = classes.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    final = classes.join(least, "comp").drop("comp", "node")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return profiles.select("doc_id", "n", "f1", "f2").join(final, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), alone)


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of every component one row, all columns as they are: the one with the smallest doc_id (null last; of repeated rows any one).

    Rows without words stay. What goes, and repeated rows that stay once, are told by hashes of doc_id and text; only rows that a bit map of
    those flags are shuffled."""
    profiles, classes = _classified(docs, k, percent, HEAVY, UNIT_MEMBERS, UNIT_SHINGLES)
    rows = profiles.where("n > 0").join(classes.select("n", "f1", "f2", "comp"), ["n", "f1", "f2"]).select("comp", "row", "doc_id", "k1", "k2")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("row"), F.lit(1).alias("best"))
    judged = rows.join(best, "row", "left").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("best").alias("best")).where("n > 1 or best is null")
    judged = Scratch(docs.sparkSession, "one").keep(judged.select("k1", "k2", F.col("best").isNotNull().alias("stays"), F.lit(True).alias("known")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r")
    keyed = _keyed(docs.select(whole, "doc_id", F.col("text").cast("binary").alias("text"))).select("r", "k1", "k2")
    sure, perhaps = sieve(keyed, "k1", judged)
    asked = perhaps.join(judged, ["k1", "k2"], "left")
    once = asked.where("stays").groupBy("k1", "k2").agg(F.first("r").alias("r"))
    kept = sure.select("r").union(asked.where("known is null").select("r")).union(once.select("r"))
    return kept.select(*(F.col("r").getField(c).alias(c) for c in docs.columns))
