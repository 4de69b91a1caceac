"""SetSketch registers: exponentially spaced truncated minima of a set's hash values.

Register i of a set is  floor(1 - log_b(e_i))  cut to [0, Q + 1], where e_i is the least of the set's exponential
values under hash i.  Registers of a union are the maxima of the registers, equal sets have equal registers, and two
sets agree in a register about as often as they are similar, so runs of registers serve as bands.  Similarity is
estimated from how many registers are larger, smaller and equal, by maximum likelihood with known set sizes.
"""

from __future__ import annotations

import numpy as np

BASE = 1.02
RATE = 20.0
Q = 2**16 - 2


def multipliers(m: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 2**32, m, dtype=np.uint32)


class SetSketch:
    def __init__(self, m: int, base: float = BASE, rate: float = RATE):
        self.m, self.base, self.rate = m, base, rate
        self.a, self.c = multipliers(m)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """Registers of a set of 64-bit hashes; memory is bounded whatever the size of the set."""
        low = np.full(self.m, np.uint32(2**32 - 1), np.uint32)
        for start in range(0, len(hashes), 512):
            x = hashes[start : start + 512]
            lo, hi = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
            with np.errstate(over="ignore"):
                y = self.a[:, None] * lo[None, :]
                y ^= hi[None, :]
                y *= np.uint32(0x85EBCA6B)
            np.minimum(low, y.min(axis=1), out=low)
        e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1.0 - np.log(e) / np.log(self.base)) + 1024, 0, Q + 1).astype(np.uint16)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Registers of the union of two sets."""
        return np.maximum(a, b)

    def similarity(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 24) -> np.ndarray:
        """Joint maximum-likelihood estimate of the Jaccard similarity for rows of registers and set sizes."""
        more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
        same = self.m - more - less
        u, v = na / (na + nb), nb / (na + nb)
        b_ = self.base

        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0.0, 1.0) * (b_ - 1.0) / b_) / np.log(b_)

        def loglik(j: np.ndarray) -> np.ndarray:
            up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
            return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1.0 - up - down, 1e-12))

        lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
        for _ in range(steps):  # the likelihood has one peak in between
            x, y = lo + (hi - lo) / 3.0, hi - (hi - lo) / 3.0
            left = loglik(x) >= loglik(y)
            hi, lo = np.where(left, y, hi), np.where(left, lo, x)
        return (lo + hi) / 2.0
