"""SentencePiece encoding and decoding, driven by an Aho-Corasick automaton over the pieces.

One pass over the text follows the automaton; at each position its output links give the pieces that end there, longest first, and each
relaxes the position's best from the best of the position where it starts.

* Unigram models: the relaxation is Viterbi's, by summed scores.
* BPE models: summed scores do not give the segmentation that merging gives, so the same pass relaxes by what merging
  keeps: a piece follows the last piece before it only if merging the two pieces' characters would leave them as they are. A
    text's segmentation by merging is the one in which all neighbours are such, so each position has one last piece. That holds
  where pieces are made of pieces of better score; runs of three spaces and more, whose pieces are not, are merged by a heap.

Characters that no piece covers become their UTF-8 bytes (byte fallback) or the unknown id. Texts are taken in units between which no
piece can reach; units are kept in a bounded cache.

A model whose normalizer changes texts is refused. Null texts count as empty; very long texts are taken whole, in time in proportion but for runs of
spaces; of equal scores the piece found first, the longest, stays; a null doc_id stays null; repeated rows repeat; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.vocab import vocabulary_path
from pairloom.llm.words import BoundedCache
from pairloom.plans.ship import ship

SPACE = "▁"
#: Letters of A-Z, a-z and Latin-1.
LATIN = "".join(chr(c) for c in range(256) if chr(c).isalpha())
_NEVER = 1 << 60


def model_kind(data: bytes) -> int:
    """trainer_spec.model_type of a serialized model: 1 unigram (the default), 2 BPE."""
    for field, value in _fields(data):
        if field == 2 and isinstance(value, bytes):
            return next((v for f, v in _fields(value) if f == 3 and isinstance(v, int)), 1)
    return 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and a varint's value or the bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def check_normalizer(data: bytes) -> None:
    """Raise unless the model leaves texts as they are but for the leading space and the mark for spaces."""
    spec = next((dict(_fields(v)) for f, v in _fields(data) if f == 3 and isinstance(v, bytes)), {})
    rules, prefix, trims, marks = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
    if rules or not prefix or trims or not marks:
        raise ValueError(f"the model's normalizer {spec.get(1, b'')!r} changes texts, which this encoder doesn't")


class Pieces:
    """Encoder and decoder for a model whose normalizer is the identity with a leading space."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        check_normalizer(data)
        self.bpe = model_kind(data) == 2
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.scores = [sp.get_score(i) for i in range(len(self.pieces))]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(len(self.pieces)))) else None
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: merging order: single characters stand from the start, others come by falling score
        self.order = {i: -1.0 if len(p) == 1 else -self.scores[i] for p, i in self.ids.items()}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pairs = BoundedCache(self._stands, 2_000_000)
        self.irregular = SPACE * 3
        inner = {p[i - 1 : i + 1] for p in self.ids for i in range(1, len(p))}
        cut = [c for c in "\n\t" if not any(c in x for x in inner)]
        ends = [c for c in ",.;:!?" if not any(x[1] == c and x[0] in LATIN for x in inner)]
        apart, tail = "".join(map(re.escape, cut)), "".join(map(re.escape, cut + ends))
        whole = any(x[1] == SPACE != x[0] for x in inner)
        self.units = re.compile("(?s).+" if whole else rf"{SPACE}*[{LATIN}]+(?=[{SPACE}{tail}]|\Z)|" + (f"[{apart}]|" if apart else "") + f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+")
        self.least = min((self.scores[i] for i in plain), default=0.0) - 10.0
        self.cache = BoundedCache(self._encode_unit, 1_000_000)
        self.table = [self._surface(i, sp) for i in range(len(self.pieces))]

    def _surface(self, i: int, sp) -> bytes:
        if sp.is_byte(i):
            return bytes([int(self.pieces[i][3:5], 16)])
        if sp.is_control(i):
            return b""
        return " ⁇ ".encode() if sp.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode("utf-8")

    # what merging does

    def merge(self, text: str) -> list[int]:
        """Merging itself, by a heap of adjacent pairs: the best score first, then the leftmost. Characters must be pieces."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if joined in self.ids:
                heappush(heap, (self.order[self.ids[joined]], i, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [self.ids[p] for p in parts if p is not None]

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i; None for single characters."""
        if i not in self.splits:
            piece, found = self.pieces[i], None
            if len(piece) > 1:
                made = [(a, b) for at in range(1, len(piece)) if (a := self.ids.get(piece[:at])) is not None and (b := self.ids.get(piece[at:])) is not None and self._stays(a) and self._stays(b) and self._stands(a << 20 | b, self.order[i])]
                found = made[0] if made else None
            self.splits[i] = found
        return self.splits[i]

    def _stays(self, i: int) -> bool:
        return len(self.pieces[i]) == 1 or self.split(i) is not None

    def _stands(self, pair: int, until: float = _NEVER) -> bool:
        """Whether merging leaves the two pieces next to each other, up to the merges of order `until`.

        Along the seam stand the right edge of the first and the left edge of the second, each growing at the times of its
        own merges; a merge across the seam that comes before the next of both breaks them."""
        left, right = [pair >> 20], [pair & 0xFFFFF]
        while (s := self.split(left[-1])) is not None:
            left.append(s[1])
        while (s := self.split(right[-1])) is not None:
            right.append(s[0])
        a, b = len(left) - 1, len(right) - 1
        while True:
            next_a = self.order[left[a - 1]] if a else _NEVER
            next_b = self.order[right[b - 1]] if b else _NEVER
            across = self.ids.get(self.pieces[left[a]] + self.pieces[right[b]])
            at = self.order[across] if across is not None else _NEVER
            if at < next_a and at <= next_b and at < until:
                return False
            if not a and not b:
                return True
            if next_a <= next_b:
                a -= 1
            if next_b <= next_a:
                b -= 1

    # encoding

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8")] if self.bytes else [self.unknown]

    def segment(self, unit: str) -> list[int]:
        if self.bpe:
            return self._merging(unit) if self.irregular in unit else self._kept(unit)
        return self._viterbi(unit)

    def _kept(self, unit: str) -> list[int]:
        """The segmentation that merging gives: each position's one piece that stands next to the piece before it."""
        n = len(unit)
        last: list[int | None] = [None] * (n + 1)
        size = [1] * (n + 1)
        pairs, last[0] = self.pairs, -1
        for end, (i, length) in self.automaton.iter(unit):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is None or before < 0 or pairs[before << 20 | i]:  # nothing merges with an uncovered character
                    last[end], size[end] = i, length
        return self._walk_back(unit, last, size)

    def _merging(self, unit: str) -> list[int]:
        out: list[int] = []
        for covered, run in itertools.groupby(unit, self.ids.__contains__):
            out += self.merge("".join(run)) if covered else [x for c in run for x in self._fallback(c)]
        return out

    def _viterbi(self, unit: str) -> list[int]:
        n, scores = len(unit), self.scores
        last: list[int | None] = [None] * (n + 1)
        size, best, done = [1] * (n + 1), [0.0] + [-1e300] * n, 0
        for end, (i, length) in [*self.automaton.iter(unit), (n, (0, 0))]:
            while done < end:  # all pieces that end up to here are seen; a character alone is the last resort
                done += 1
                if best[done - 1] + self.least > best[done] and unit[done - 1] not in self.ids:
                    best[done], last[done], size[done] = best[done - 1] + self.least, None, 1
            end += 1
            if length and best[end - length] + scores[i] > best[end]:
                best[end], last[end], size[end] = best[end - length] + scores[i], i, length
        return self._walk_back(unit, last, size)

    def _walk_back(self, unit: str, last: list, size: list) -> list[int]:
        out: list[int] = []
        at = len(unit)
        while at > 0:
            if last[at] is None:
                out.extend(reversed(self._fallback(unit[at - 1])))
            else:
                out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _encode_unit(self, unit: str) -> bytes:
        return array("I", self.segment(unit)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, self.units.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids, without the leading space that encoding puts before it."""
        text = b"".join(map(self.table.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text.removeprefix(" ")


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    return vocabulary_path("piece_bpe_32k.model")


def _encode(find: Callable[[], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(find())
        for batch in batches:
            n, sums, same = [], [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                ids = p.encode(t)
                n.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                same.append(p.decode(ids) == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def _ids(find: Callable[[], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(find())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([array("I", p.encode(t.as_py() or "")).tolist() for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, model: Callable[[], str] = default_model) -> DataFrame:
    """doc_id, ids array<int>."""
    return ship(docs).select("doc_id", "text").mapInArrow(_ids(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def encode_digest(docs: DataFrame, model: Callable[[], str] = default_model) -> DataFrame:
    """doc_id, n_ids long, ids_crc32 long (of the little-endian 32-bit ids), round_trip boolean (decoding gives the text again)."""
    return ship(docs).select("doc_id", "text").mapInArrow(_encode(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
