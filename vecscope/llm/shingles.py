"""Word shingles as 64-bit hashes, made in numpy inside Arrow batches.

Words are runs of bytes other than \\x20 and \\x09-\\x0D after A-Z are lower-cased; a text of fewer than `k` words has
one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)
WORDS_KEPT = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit integer over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _SHIFT)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _SHIFT)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> _SHIFT)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


class Shingler:
    """Shingle hashes of texts; keeps a bounded cache of word hashes."""

    def __init__(self, k: int = 5):
        self.k = k
        self._hash = _Hashes()

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        return text.encode(errors="surrogatepass").lower().split() if text else []

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """One hash for each window of k words, in order."""
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self._hash.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            k = min(self.k, n)
            s = h[: n - k + 1].copy()
            for j in range(1, k):
                s = s * _M + h[j : n - k + 1 + j]
            return mix(s + np.uint64(k))

    def distinct(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        return np.unique(self.sequence(self.words(text)))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
