"""64-bit hashes of ranges in a sequence, all at once: prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class RangeHash:
    """Hashes of ranges of the values it is given; equal ranges get equal hashes wherever they stand."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n + n // 4), _powers(_INVERSE, n + n // 4)
        sums = np.empty(n, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.up[:n - 1], dtype=np.uint64, out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(found + (ends - starts).astype(np.uint64) * _M2)
