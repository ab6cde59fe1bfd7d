"""Hashed word shingles of a text and min-hash signatures over them, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 14)
        a, b = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        a[0] = b[0] = 1
        _powers, _inverses = np.multiply.accumulate(a), np.multiply.accumulate(b)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    _grow(len(b) + 1)
    inside = np.concatenate(([0], ~_SPACE[b], [0])).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[: len(b)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of all its words where it has fewer; none without words."""
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n])
    return np.unique(total)


class MinHash:
    """Minima of the set under `size` multiply-add functions."""

    def __init__(self, size: int, seed: int = 17):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, size, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            np.minimum(low, (s[i : i + 1024, None] * self.a + self.b).min(axis=0), out=low)
        return low
