"""The 64-bit xxHash of bigint columns, on numpy arrays, equal to the SQL function ``xxhash64``.

Lets Python code that receives hashed rows recompute positions and checks that
were computed in SQL.
"""

from __future__ import annotations

import numpy as np

#: The five primes of the published XXH64 algorithm and the seed of SQL ``xxhash64``.
PRIMES = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
SEED = 42


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(*columns: np.ndarray | int) -> np.ndarray:
    """Hash of bigint columns (int64 arrays or scalars) as int64."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in PRIMES)
    arrays = np.broadcast_arrays(*[np.atleast_1d(np.asarray(c, dtype=np.int64)) for c in columns])
    state = np.full(arrays[0].shape, SEED, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in arrays:
            h = state + p5 + np.uint64(8)
            h ^= _rotate(a.astype(np.uint64) * p2, 31) * p1
            h = _rotate(h, 27) * p1 + p4
            h ^= h >> np.uint64(33)
            h *= p2
            h ^= h >> np.uint64(29)
            h *= p3
            h ^= h >> np.uint64(32)
            state = h
    return state.astype(np.int64)
