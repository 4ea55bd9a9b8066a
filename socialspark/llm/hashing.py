"""Hashes of spans of bytes, from one pass of prefix sums."""

from __future__ import annotations

import numpy as np

_random = np.random.Generator(np.random.PCG64(20240501))
_VALUES = _random.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = _random.integers(0, 1 << 62, 2, np.uint64) * np.uint64(4) + np.uint64(3)
_INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, _BASES[which]), np.full(size, _INVERSES[which])
        up[0] = down[0] = 1
        have = _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits; equal values stay equal, different ones different."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Spans:
    """Hashes of spans of ``data``; ``which`` picks one of two independent functions."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        up, self._down = _powers_of(which, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[which][data] * up[:-1], out=self._sums[1:])

    def hash(self, start, stop) -> np.ndarray:
        """Hashes of ``data[start:stop]`` for arrays of bounds, or for two slices of equal length."""
        return mix((self._sums[stop] - self._sums[start]) * self._down[start])
