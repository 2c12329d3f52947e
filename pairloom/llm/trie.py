"""Prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. Its key is 128 bits: the exclusive or, over its turns, of two hashes of a turn's depth, role and text,
so a running window gives the keys of all prefixes of a conversation, and nodes are groups of equal keys.

The heavy child of a node is the one with most member conversations; chains of heavy children are the heavy paths. Each path ends in a leaf, and the smallest
member of that leaf walks the whole chain from the root, so a window over its nodes finds the path's head, its parent's conversation and how many light edges lie above it. A
light edge at least halves the members, so this level is logarithmic in the conversations. Levels are worked from the deepest up: suffix sums along the
paths of a level give the sums of subtrees, and the heads' sums are attached to their parents, on paths one level up.

Skew: nodes are counted with partial sums. Nodes that hold over a 1024th of all (conversation, depth) rows, fewer than 1,024 by that, are looked up by broadcast, the
others by a join. The conversations that end in one node are written to chunks by ranges before they meet, and are hashed as a stream. A conversation is one
window, which spills; the list of conversations that share a base is as long as `group` allows.

Null roles and texts are empty. Null turns come first; equal turns are taken by role, then text; repeated rows are turns of their own. Rows with null conv_id
belong to no conversation and take no part. c - c % 5 is SQL's (toward zero). An empty table has no conversation and gives no node, not even a root. Only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

#: Nodes with more than one in so many of all rows are broadcast; so there are fewer of them.
HOT = 1024
#: Bytes of written ids that go to the hashing task in one row.
CHUNK = 1 << 20
KEY = ["depth", "ka", "kb"]


def numbered_turns(conversations: DataFrame, *near: str) -> DataFrame:
    """conv_id, place (from 1), a, b (hashes of role and text), bytes (of the text), and the columns `near`, which conv_id must determine."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy(*near, "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), *near)
    return said.select("conv_id", *near, F.row_number().over(order).alias("place"), F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"), F.octet_length("text").cast("long").alias("bytes"))


def whole(conversations: DataFrame) -> DataFrame:
    """Rows for `prefix_trie`: every conversation as it stands."""
    rows = numbered_turns(conversations)
    at = F.explode(F.when(F.col("place") == 1, F.array(F.lit(0), F.col("place"))).otherwise(F.array("place")))
    return _turns_at(rows.select("conv_id", F.col("conv_id").alias("near"), "a", "b", "bytes", at.alias("depth")))


def shared_turns(conv_id: Column, modulus: int) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % modulus


def spliced(conversations: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """Rows for `prefix_trie`: conversation c takes its first h turns from conversation c - c % group, h = crc32(c) % modulus, and its own turns after its first h.

    One shuffle by c - c % group serves the numbering, the splicing and the keys."""
    base = F.col("conv_id").cast("long") - F.col("conv_id").cast("long") % group
    together = Window.partitionBy("near")
    rows = numbered_turns(conversations.withColumn("near", base), "near")
    rows = rows.withColumn("ids", F.collect_set("conv_id").over(together)).withColumn("lent", F.coalesce(F.max(F.when(F.col("conv_id") == F.col("near"), F.col("place"))).over(together), F.lit(0)))
    h = shared_turns(F.col("conv_id"), modulus)
    at = lambda c, depth: F.struct(c.alias("conv_id"), depth.cast("int").alias("depth"))
    lend = F.transform(F.filter("ids", lambda x: (x == F.col("near")) | (shared_turns(x, modulus) >= F.col("place"))), lambda x: at(x, F.col("place")))
    own = F.when(F.col("place") > h, F.array(at(F.col("conv_id"), F.col("place") - h + F.least(h, F.col("lent"))))).otherwise(F.filter(F.array(at(F.col("conv_id"), F.lit(0))), lambda x: F.lit(False)))
    turns = F.when(F.col("conv_id") == F.col("near"), lend).otherwise(own)
    places = F.when(F.col("place") == 1, F.concat(F.array(at(F.col("conv_id"), F.lit(0))), turns)).otherwise(turns)
    return _turns_at(rows.select("near", "a", "b", "bytes", F.explode(places).alias("at")).select("near", "at.*", "a", "b", "bytes"))


def _turns_at(rows: DataFrame) -> DataFrame:
    """Turns hashed with their depth; the row of depth 0 has no turn."""
    turn = lambda c: F.when(F.col("depth") == 0, 0).otherwise(c)
    return rows.select("near", "conv_id", F.col("depth").cast("int").alias("depth"), turn(F.xxhash64("a", "depth")).alias("a"), turn(F.xxhash64("depth", "b")).alias("b"), turn(F.col("bytes")).alias("bytes"))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) to rows (key, first conv_id, comma-joined ids of CHUNK bytes about)."""
    key, first, ids, size = None, 0, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([key[2]]), pa.array([first]), pa.array([",".join(ids)])], names=[*KEY, "first", "ids"])

    for batch in batches:
        out: list[tuple] = []
        for depth, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != (depth, a, b) or size > CHUNK:
                if key is not None:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = (depth, a, b), c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c) for c in cols[1:])], names=[*KEY, "first", "ids"])
    if key is not None:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to a digest for each key; only one chunk is held."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for depth, a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if key != (depth, a, b):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c) for c in cols[1:])], names=[*KEY, "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([key[2]]), pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """Of rows (depth, ka, kb, conv_id) the digest of each key's ids, ascending, as text joined by commas. Ranges write the ids, so a key with most of the rows is written by many tasks."""
    rows = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = ship(rows).mapInArrow(_written, "depth int, ka long, kb long, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "depth int, ka long, kb long, ends_sha256 string")


def _counted(members: DataFrame) -> DataFrame:
    """The nodes, with their members, children and whether they are their parent's heavy child."""
    nodes = members.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("bytes").alias("bytes"))
    child = F.struct("n_convs", "ka", "kb")
    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"), F.max(child).alias("h"))
    heavy = parents.select((F.col("depth") + 1).alias("depth"), F.col("h.ka").alias("ka"), F.col("h.kb").alias("kb"), F.lit(0).alias("light"))
    return nodes.join(parents.drop("h"), KEY, "left").join(heavy, KEY, "left").na.fill({"n_children": 0, "light": 1})


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    turns: near (which conv_id determines; rows are dealt by it), conv_id, depth (0 once for each conversation, then each turn's), a, b, bytes."""
    scratch = Scratch(turns.sparkSession, "trie")
    along = Window.partitionBy("near", "conv_id").orderBy("depth")
    keyed = turns.withColumn("ka", F.bit_xor("a").over(along)).withColumn("kb", F.bit_xor("b").over(along))
    keyed = keyed.select("conv_id", *KEY, F.lag("ka").over(along).alias("pa"), F.lag("kb").over(along).alias("pb"), "bytes", F.lead("depth").over(along).isNull().alias("last"))
    members = scratch.keep(keyed)
    nodes = scratch.keep(_counted(members))

    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    of_leaf = nodes.where("n_children = 0").select("conv_id")
    walks = members.join(of_leaf, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), *KEY)
    known = nodes.select(*KEY, "conv_id", "n_convs", "n_children", "light", "pa", "pb", "bytes")
    hot = known.where(F.col("n_convs") * HOT > total)
    near = scratch.keep(walks.join(F.broadcast(hot), KEY, "left"))
    missing = near.where("conv_id is null").select("path", *KEY).join(known, KEY)
    steps = near.where("conv_id is not null").unionByName(missing)

    one, down = Window.partitionBy("path"), Window.partitionBy("path").orderBy("depth")
    steps = steps.withColumn("head", F.max(F.when(F.col("light") == 1, F.col("depth"))).over(one)).withColumn("level", F.sum("light").over(one)).withColumn("parent_conv_id", F.lag("conv_id").over(down))
    own = steps.where("depth >= head").withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    paths = scratch.keep(own.drop("light", "bytes").sortWithinPartitions("level", "path", "depth"))

    up = Window.partitionBy("path").orderBy(F.desc("depth"))
    attached, done = None, []
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        at = paths.where(F.col("level") == level)
        if attached is not None:
            at = at.join(attached, KEY, "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        summed = at.withColumn("n_leaves", F.sum("leaves").over(up)).withColumn("saved_tokens", F.sum("saved").over(up))
        done.append(scratch.keep(summed.select(*KEY, "head", "pa", "pb", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")))
        attached = done[-1].where("depth = head and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    found = functools.reduce(DataFrame.unionByName, done) if done else paths.withColumns({"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})
    digests = ends_digests(members.where("last"))
    return found.join(digests, KEY, "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
