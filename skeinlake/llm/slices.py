"""Pairs of 64-bit codes within a Hamming distance, compared only where a slice of their bits is equal.

Codes that differ in at most ``families - 1`` bits are equal in one of ``families`` slices at
least, so comparing the codes of one cell (those equal in the slice) of every family misses
nothing. A pair is given in the first family it is equal in, and so once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs compared at once, and pairs in a cell from which its matrix is cheaper than their list.
PAIRS, MATRIX = 1 << 21, 1 << 12


def cuts(families: int) -> list[int]:
    """First bits of the slices, and 64."""
    return [64 * i // families for i in range(families + 1)]


def _mask(family: int, families: int) -> np.uint64:
    low, high = cuts(families)[family : family + 2]
    return np.uint64(((1 << (high - low)) - 1) << low)


def by_cell(codes: np.ndarray, family: int, families: int) -> np.ndarray:
    """The order that puts the codes of a cell side by side."""
    return np.argsort(codes & _mask(family, families), kind="stable")


def near(queries: np.ndarray, codes: np.ndarray, family: int, families: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, code) as positions in ``queries`` and in ``codes``, which are in the order of ``by_cell``."""
    if radius >= families:
        raise ValueError(f"{families} slices find codes within {families - 1} bits, not {radius}")
    if not len(queries) or not len(codes):
        return
    mask, earlier = _mask(family, families), [_mask(f, families) for f in range(family)]
    order = by_cell(queries, family, families)
    cells, first, asked = np.unique((queries & mask)[order], return_index=True, return_counts=True)
    held = codes & mask
    low, high = np.searchsorted(held, cells, "left"), np.searchsorted(held, cells, "right")

    def once(q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = queries[q] ^ codes[n]
        for m in earlier:
            new = apart & m != 0
            q, n, apart = q[new], n[new], apart[new]
        return q, n

    size = asked * (high - low)
    for c in np.flatnonzero(size >= MATRIX):
        there = codes[low[c] : high[c]]
        step = max(1, PAIRS // len(there))
        for start in range(first[c], first[c] + asked[c], step):
            at = order[start : min(start + step, first[c] + asked[c])]
            q, n = np.nonzero(np.bitwise_count(queries[at][:, None] ^ there[None, :]) <= radius)
            yield once(at[q], n + low[c])

    small = (size > 0) & (size < MATRIX)
    cell = np.repeat(np.flatnonzero(small), asked[small])
    at = order[np.repeat(small, asked)]
    many = (high - low)[cell]
    ends = np.cumsum(many)
    start = 0
    while start < len(at):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right"))
        own = many[start:stop]
        q = np.repeat(at[start:stop], own)
        n = np.arange(len(q)) + np.repeat(low[cell[start:stop]] - (np.cumsum(own) - own), own)
        close = np.flatnonzero(np.bitwise_count(queries[q] ^ codes[n]) <= radius)
        yield once(q[close], n[close])
        start = stop
