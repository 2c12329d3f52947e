"""Words and word hashes of whole texts, as the executors' Python workers compute them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers for the positions of a shingle, and the finishing multiplier.
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD6E8FEB86659FD93 << (i % 5)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], dtype=np.uint64)
_END = np.uint64(0xFF51AFD7ED558CCD)


class BoundedCache(dict):
    """A dict that computes what it lacks, keeps it for keys of `longest` characters at most (integers are kept), and starts afresh when it holds `limit` entries."""

    def __init__(self, make, limit: int = 50_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        if not isinstance(key, int) and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_hashes = BoundedCache(xxhash.xxh3_64_intdigest)


def finish(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _END
    return x ^ (x >> np.uint64(29))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of other bytes than \\x20 and \\x09-\\x0D, A-Z lower-cased; bytes.lower and bytes.split know just these."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value for each window of k word hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    x = h[:n] * _ODD[0]
    for i in range(1, k):
        x = x + h[i : i + n] * _ODD[i]
    return finish(x)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; fewer words make one shingle of them all, no words make none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    if len(h) < k:
        return finish((h * _ODD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _ODD[32 + len(h)])
    return np.unique(windows(h, k))
