"""Token counts by byte-pair merging with a heap and a linked list.

A pre-token's bytes are symbols in a doubly linked list; a heap holds the adjacent pairs that have a merge, lowest rank
and then leftmost first. Popping a pair that still stands merges it; the count is the initial symbols less the merges,
and no identifiers are put out. Counts of pre-tokens are kept in a bounded cache. Strings of the vocabulary file's added
tokens count one each where they stand in a text, as the library takes them by default.

Nulls and empty texts count 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give repeated rows; an empty
table gives an empty result; columns other than doc_id and text are not read. Texts are counted whole; cost is
O(n log n) in the length of the longest pre-token, so long runs without a break are no special case.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.vocab import byte_symbols, split_text, vocabulary_path
from pairloom.llm.words import BoundedCache
from pairloom.plans.ship import ship

_BITS = 20
_LOW = (1 << _BITS) - 1


class HeapMerger:
    """Counts tokens under the vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_ids = [ids[x] for x in symbols]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[ids[a] << _BITS | ids[b]] = rank << _BITS | ids[a + b]
        self.added = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.cache = BoundedCache(self.count_piece, 1_200_000)

    def count_piece(self, piece: str) -> int:
        ids, find = self.byte_ids, self.pairs.get
        symbols = [ids[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        live = [find(a << _BITS | b, -1) for a, b in zip(symbols, symbols[1:])]  # what stands at each place and can merge
        heap = [v << 32 | i for i, v in enumerate(live) if v >= 0]
        if not heap:
            return n
        live.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            at, value = top & 0xFFFFFFFF, top >> 32
            if live[at] != value:
                continue  # one of the two is part of another symbol by now
            merges += 1
            merged = symbols[at] = value & _LOW
            right = after[at]
            live[right] = -1
            follows = after[at] = after[right]
            if follows < n:
                before[follows] = at
                v = live[at] = find(merged << _BITS | symbols[follows], -1)
                if v >= 0:
                    heappush(heap, v << 32 | at)
            else:
                live[at] = -1
            leads = before[at]
            if leads >= 0:
                v = live[leads] = find(symbols[leads] << _BITS | merged, -1)
                if v >= 0:
                    heappush(heap, v << 32 | leads)
        return n - merges

    def count(self, text: str) -> int:
        for i, special in enumerate(self.added):
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.count, parts))
        return sum(map(self.cache.__getitem__, split_text(text)))


@functools.lru_cache(2)
def merger(path: str) -> HeapMerger:
    return HeapMerger(path)


def _counts(find: Callable[[], str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(find())
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            tokens = [m.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def default_vocabulary() -> str:
    return vocabulary_path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: Callable[[], str] = default_vocabulary) -> DataFrame:
    """doc_id, n_bytes long, n_tokens long, over_limit boolean for each row of docs. `vocabulary` gives the file's path on the executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ship(docs).select("doc_id", "text").mapInArrow(_counts(vocabulary, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
