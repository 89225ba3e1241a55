"""Hashes of any spans of a symbol stream from one running sum, with tables whose size is fixed.

A span's hash is the sum of its scrambled symbols times powers of a base, turned back by the power
of its first place. Powers are the product of two table entries (place within a block, block), so
nothing of the stream's size is kept between calls.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed random multipliers for hashing symbols and places; any odd numbers would do.
_RNG = np.random.default_rng(20240229)
SALT = _RNG.integers(1, 2**63, 4, np.uint64) | np.uint64(1)
BASE = int(SALT[0]) | 5
BITS = 15
BLOCK = 1 << BITS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % 2**64, np.uint64)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


@lru_cache(maxsize=1)
def _within() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for the places of a block; scrambled bytes."""
    return _powers(BASE, BLOCK), _powers(pow(BASE, -1, 2**64), BLOCK), mix(np.arange(256, dtype=np.uint64) + SALT[1])


class Prefix:
    """The running sum of a stream of bytes, code points or 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self._down, scrambled = _within()
        far = _powers(pow(BASE, BLOCK, 2**64), n // BLOCK + 1)
        self._far = _powers(pow(BASE, -BLOCK, 2**64), n // BLOCK + 1)
        self.total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, n, BLOCK):
                part = symbols[k : k + BLOCK]
                part = scrambled[part] if part.dtype == np.uint8 else mix(part.astype(np.uint64) + SALT[1])
                out = self.total[k + 1 : k + 1 + len(part)]
                np.cumsum(part * up[: len(part)], out=out)
                out *= far[k >> BITS]
                out += self.total[k]

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the spans [a, b), independent of where they stand."""
        with np.errstate(over="ignore"):
            down = self._down[a & (BLOCK - 1)] * self._far[a >> BITS]
            return mix((self.total[b] - self.total[a]) * down + (b - a).astype(np.uint64) * SALT[2])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k symbols from each place on."""
        n = len(self.total) - k
        out = np.empty(max(0, n), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, n, BLOCK):
                x = self.total[i + k : min(n, i + BLOCK) + k] - self.total[i : min(n, i + BLOCK)]
                out[i : i + len(x)] = mix(x * self._down[: len(x)] * self._far[i >> BITS])
        return out


def span_hashes(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [a, b) of a stream."""
    return Prefix(symbols).spans(a, b)
