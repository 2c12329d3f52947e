"""Packing documents into sequences by first-fit decreasing, with a tournament tree of bin capacities.

A document's ids (and a closing id) are cut at multiples of the sequence length; whole pieces are sequences by
themselves, the rest of each document is an item. Pieces are written to a table first and dealt from there into randomised groups by a
seeded hash of their place in it; a piece's place is settled once it is written, so equal rows, however many, are spread over all groups and a
lost task deals as before. The number of groups follows the number of pieces, so a group has a bounded expected size whatever the rows hold.
In a group the items go, longest first (ties by doc_id, start), into the leftmost bin with room; the tree over bin
capacities finds it in O(log bins). A sequence whose length is a power of two is not padded.

Ids are those of the tokenizer file: its model gives the ids of each pre-token, strings of its added tokens are their ids.

Nulls and empty texts are documents of the closing id alone; a null doc_id stays null; repeated rows are packed each by itself; very long texts
are cut into as many pieces as they need; pieces of equal length go by doc_id, start and content; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.vocab import byte_symbols, split_text, vocabulary_path
from pairloom.llm.words import BoundedCache
from pairloom.plans.lineage import Scratch
from pairloom.plans.ship import ship

#: Pieces dealt to a group, on average.
GROUP_PIECES = 8192

PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long"


class PieceEncoder:
    """Little-endian 32-bit ids of whole texts under a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        model, symbols = Tokenizer.from_file(path).model, byte_symbols()
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens", [])
        self.cache = BoundedCache(lambda piece: array("I", [t.id for t in model.tokenize("".join(symbols[b] for b in piece.encode("utf-8")))]).tobytes(), 300_000)
        self.special = {x["content"]: array("I", [x["id"]]).tobytes() for x in sorted(added, key=lambda x: -len(x["content"]))}

    def encode(self, text: str) -> bytes:
        for special, packed in self.special.items():
            if special in text:
                return packed.join(map(self.encode, text.split(special)))
        return b"".join(map(self.cache.__getitem__, split_text(text)))


@functools.lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def default_vocabulary() -> str:
    return vocabulary_path("byte_bpe_50k.json")


def _pieces(find: Callable[[], str], size: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(find()), array("I", [closing]).tobytes()
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = e.encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class TournamentTree:
    """Capacities of bins at the leaves, the larger of two at each inner node; finds the leftmost bin with room."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def place(self, length: int) -> int:
        room, at = self.room, 1
        while at < self.width:
            at *= 2
            if room[at] < length:
                at += 1
        room[at] -= length
        found = at - self.width
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item; items come longest first."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), {}
    for i, n in enumerate(lengths.tolist()):
        bins[i] = b = tree.place(n)
        offsets[i] = used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return bins, offsets


def _pack(size: int):
    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        whole = int((pdf["length"] == size).sum())
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy()[whole:], size)
        local = np.concatenate([np.arange(whole), whole + bins])
        pdf["sequence_id"] = (pdf["bucket"].to_numpy().astype(np.int64) << 32) | local
        pdf["offset"] = np.concatenate([np.zeros(whole, np.int64), offsets])
        return pdf.drop(columns="bucket")

    return run


def pack_documents(docs: DataFrame, size: int = 2048, closing: int = 1, group_pieces: int = GROUP_PIECES, seed: int = 17, vocabulary: Callable[[], str] = default_vocabulary) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long): a row per piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = ship(docs).select("doc_id", "text").mapInArrow(_pieces(vocabulary, size, closing), PIECES.format(kind))
    pieces = Scratch(docs.sparkSession, "packing").keep(made.withColumn("place", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(groups)).cast("int")).drop("place")
    return dealt.groupBy("bucket").applyInPandas(_pack(size), f"{PIECES.format(kind)}, sequence_id long, offset long")
