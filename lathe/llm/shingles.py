"""Word shingles and MinHash values of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """64 bits for each word; words are parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out = out * _P + hashes[k : n + k]
        return mixed(out)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct shingles, sorted. A text with fewer words has one, all its words; one without words has none."""
    hashes = word_hashes(text)
    return np.unique(windows(hashes, min(size, max(1, len(hashes)))))


class MinHash:
    """``n`` MinHash values by multiply-shift, and the hashes of bands of ``rows`` of them."""

    def __init__(self, n: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n, self.rows, self.bands = n, rows, n // rows
        self.factors = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2**63, n, dtype=np.uint64)

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set, none of them empty."""
        joined = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), self.n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                out[:, k] = np.minimum.reduceat(joined * self.factors[k] + self.offsets[k], starts)
            return mixed(out)

    def band_hashes(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.arange(1, self.bands + 1, dtype=np.uint64) * _Q
            for r in range(self.rows):
                out = mixed(out * _P + values[:, r :: self.rows][:, : self.bands])
            return out
