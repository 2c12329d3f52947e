"""Fuzzy ratios from 0 to 100, on the indel distance. Longest common subsequences of whole texts are computed on bit rows, those of all windows by combing."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.ship import ship

#: Pairs of texts that are combed at once at most, and characters of their longer texts, unless one alone has more.
ROWS, CHARACTERS = 64, 1 << 20


def _masks(s: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(s):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _lcs(masks: dict[str, int], size: int, other: str) -> int:
    full = row = (1 << size) - 1
    for c in other:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


def _score(common: int, total: int) -> float:
    return 200.0 * common / total if total else 100.0


def ratio(a: str, b: str) -> float:
    return _score(_lcs(_masks(a), len(a), b), len(a) + len(b))


def _comb(short: np.ndarray, long_: np.ndarray) -> np.ndarray:
    """Rows of two texts' characters to the strands that end under each character of the long one (iterative combing, Tiskin).

    The longest common subsequence of the short text with the characters i to j of the long one is j - i less the strands under places before j that
    start at m + i or after it, m being the width of the short rows; so one pass knows all windows. Cells of a diagonal don't hang on one another."""
    (rows, m), n = short.shape, long_.shape[1]
    kind = np.int16 if m + n < 1 << 15 else np.int32
    last, above = np.ascontiguousarray(short[:, ::-1].T), np.ascontiguousarray(long_.T)
    across, down = (np.tile(np.arange(a, b, dtype=kind)[:, None], (1, rows)) for a, b in ((0, m), (m, m + n)))
    for d in range(m + n - 1):
        a, b = max(0, d - m + 1), min(n, d + 1)
        of_short = slice(m - 1 - d + a, m - 1 - d + b)
        x, y = across[of_short], down[a:b]
        swaps = last[of_short] == above[a:b]
        swaps |= x > y
        change = x ^ y
        change *= swaps
        x ^= change
        y ^= change
    return down.T.astype(np.int64)


def _best_window(strands: np.ndarray, wide: int, m: int) -> float:
    """The best ratio of a short text of m characters with windows of m characters of the long one, those cut off at its ends included.

    strands: under the long text's characters, from rows `wide` characters wide."""
    n = len(strands)
    start = strands - wide
    top, end = start >= 0, np.arange(n)
    s, r = start[top], end[top]
    windows = np.zeros(n + 2, np.int64)  # a strand from s to r counts in windows that begin after r - m, up to s
    opens = np.maximum(0, r - m + 1)
    counts = opens <= s
    np.add.at(windows, opens[counts], 1)
    np.add.at(windows, s[counts] + 1, -1)
    best = 0.0
    if n >= m:
        best = float((m - np.cumsum(windows)[: n - m + 1]).max()) / m
    k = np.arange(1, min(m, n + 1))
    if len(k):
        first = k - np.cumsum(top)[k - 1]
        final = k - np.cumsum(np.bincount(s, minlength=n)[::-1])[k - 1]
        best = max(best, float((2 * np.maximum(first, final) / (m + k)).max()))
    return 100.0 * best


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(texts: list[str], filling: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), filling, np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = _codes(t)
    return out


def partial_ratios(pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """For each pair the best ratio of the shorter text with a window of the longer, windows cut off at both ends included.

    Pairs of like lengths are combed together; what fills them up matches nothing."""
    found: dict[tuple[str, str], float] = {}
    work: list[tuple[str, str, tuple[str, str]]] = []
    for pair in dict.fromkeys(pairs):
        short, long_ = sorted(pair, key=len)
        if not short or short in long_:
            found[pair] = 100.0 if short or not long_ else 0.0
            continue
        work.append((short, long_, pair))
        if len(short) == len(long_):
            work.append((long_, short, pair))
    work.sort(key=lambda w: (len(w[1]), len(w[0])))
    while work:
        rows = max(1, min(ROWS, CHARACTERS // len(work[-1][1])))
        work, some = work[:-rows], work[-rows:]
        short = _padded([w[0] for w in some], 0xFFFFFFFF)
        strands = _comb(short, _padded([w[1] for w in some], 0xFFFFFFFE))
        for (a, b, pair), row in zip(some, strands):
            found[pair] = max(found.get(pair, 0.0), _best_window(row[: len(b)], short.shape[1], len(a)))
    return found


def partial_ratio(a: str, b: str) -> float:
    return partial_ratios([(a, b)])[a, b]


def _parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _parts(a, b)
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    n, m = len(both) + gap + len(left), len(both) + gap + len(right)
    changed = len(left) + len(right) - 2 * _lcs(_masks(left), len(left), right)
    best = 100.0 * (1 - changed / (n + m)) if n + m else 100.0
    if both:
        best = max(best, *(100.0 * (1 - (gap + len(x)) / (2 * len(both) + gap + len(x))) for x in (left, right)))
    return best


def _sorted_tokens(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_tokens(a), _sorted_tokens(b))


def _spread(a: str, b: str) -> float:
    return max(len(a), len(b)) / min(len(a), len(b)) if a and b else 0.0


def partial_pairs(a: str, b: str) -> list[tuple[str, str]]:
    """The pairs whose partial ratios `weighted_ratio` asks for."""
    if _spread(a, b) < 1.5:
        return []
    both, left, right = _parts(a, b)
    return [(a, b)] if both else [(a, b), (_sorted_tokens(a), _sorted_tokens(b)), (left, right)]


def weighted_ratio(a: str, b: str, known: dict[tuple[str, str], float] | None = None) -> float:
    """The best of the plain, token and (for unlike lengths) partial ratios, each with its weight. `known` holds partial ratios, if they have been made."""
    if not a or not b:
        return 0.0
    if _spread(a, b) < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if _spread(a, b) <= 8 else 0.6
    whole, *tokens = partial_pairs(a, b)
    known = partial_ratios([whole, *tokens]) if known is None else known
    of_tokens = max(known[p] for p in tokens) if tokens else 100.0
    return max(ratio(a, b), scale * known[whole], 0.95 * scale * of_tokens)


def fuzzy_ratios(pairs: DataFrame) -> DataFrame:
    """id, weighted_ratio, token_set_ratio, partial_ratio (float); null texts count as empty."""

    @F.pandas_udf("struct<weighted_ratio: float, token_set_ratio: float, partial_ratio: float>")
    def three(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        texts = list(zip(a, b))
        known = partial_ratios(itertools.chain(texts, itertools.chain.from_iterable(partial_pairs(x, y) for x, y in texts)))
        rows = [(weighted_ratio(x, y, known), token_set_ratio(x, y), known[x, y]) for x, y in texts]
        return pd.DataFrame(rows, columns=["weighted_ratio", "token_set_ratio", "partial_ratio"], dtype="float32")

    texts = (F.coalesce(c, F.lit("")) for c in ("question1", "question2"))
    return ship(pairs).select("id", three(*texts).alias("r")).select("id", "r.*")
