"""Vectorised 64-bit hashes of byte ranges."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LEAST = 19  # tables have 2^19 entries or more, so that few sizes are kept


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64)) * np.uint64(pow(base, -1, 1 << 64))


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    size = 1 << max(_LEAST, n.bit_length())
    return _powers(_BASES[which], size)[:n], _powers(pow(_BASES[which], -1, 1 << 64), size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_ranges(codes: np.ndarray, which: int, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
    """Polynomial hashes of codes[first:last], the same wherever a string stands."""
    powers, inverses = _tables(which, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers[:-1], out=sums[1:])
    return (sums[last] - sums[first]) * inverses[first]
