"""Deciding a batch that one task can hold, by the rounds of ``HistoryIndex._decide`` on arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from skeinlake.llm import slices

#: Schemas of what goes in (fresh: matches nothing in the history) and comes out: kind kept tells what is accepted, the others what a signature matches.
IN, OUT = ["node", "sha", "code", "coded", "fresh"], "sha string, code long, accepted string, kind string"
NONE = np.iinfo(np.int64).max


def _pairs(asked: np.ndarray, held: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in both, each once."""
    for family in range(radius + 1):
        order = slices.by_cell(held, family, radius + 1)
        for q, n in slices.near(asked, held[order], family, radius + 1, radius):
            yield q, order[n]


def _kept(sha: np.ndarray, code: np.ndarray, codes: np.ndarray, fresh: np.ndarray, radius: int) -> np.ndarray:
    """Which signatures, numbered in order, a pass over the fresh ones accepts; sha and code are numbers, -1 where there is none."""
    n = len(sha)
    at = np.arange(n)
    kept, undecided, last = np.zeros(n, dtype=bool), fresh.copy(), np.zeros(n, dtype=bool)
    crowded = np.ones(len(codes), dtype=bool)
    while undecided.any():
        live = undecided | last
        owner = np.where(last, at - n, at)
        first = np.full(n, NONE)
        for key, size in ((sha, sha.max(initial=-1) + 1), (code, len(codes))):
            least = np.full(size, NONE)
            held = live & (key >= 0)
            np.minimum.at(least, key[held], owner[held])
            own = undecided & (key >= 0)
            first[own] = np.minimum(first[own], least[key[own]])
        there = np.flatnonzero((least < NONE) & crowded)  # least: of the codes
        asked = np.unique(code[undecided & (code >= 0)])
        asked = asked[crowded[asked]]
        near = np.full(len(codes), NONE)
        for q, c in _pairs(codes[asked], codes[there], radius):
            other = asked[q] != there[c]
            np.minimum.at(near, asked[q[other]], least[there[c[other]]])
        crowded[asked] = near[asked] < NONE
        own = undecided & (code >= 0)
        first[own] = np.minimum(first[own], near[code[own]])
        last = undecided & (first == at)
        kept |= last
        undecided &= ~last & (first >= 0) & ~last[np.clip(first, 0, n - 1)]
    return kept


def decide(radius: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=IN), *(b for b in batches if len(b))], ignore_index=True).sort_values("node", kind="stable", ignore_index=True)
        coded, fresh = rows["coded"].to_numpy(dtype=bool), rows["fresh"].to_numpy(dtype=bool)
        values = rows["code"].to_numpy(dtype=np.int64)
        codes, number = np.unique(values[coded].view(np.uint64), return_inverse=True)
        code = np.full(len(rows), -1)
        code[coded] = number
        nodes, texts = rows["node"].to_numpy(dtype=object), rows["sha"].to_numpy(dtype=object)
        sha, _ = pd.factorize(texts)
        kept = _kept(sha, code, codes, fresh, radius)

        def out(signatures: np.ndarray, accepted: np.ndarray, kind: str) -> pd.DataFrame:
            held = pd.arrays.IntegerArray(values[signatures].copy(), ~coded[signatures])
            return pd.DataFrame({"sha": texts[signatures], "code": held, "accepted": nodes[accepted], "kind": kind})

        chosen = np.flatnonzero(kept)
        yield out(chosen, chosen, "kept")
        by_sha = np.full(sha.max(initial=-1) + 1, -1)
        by_sha[sha[kept & (sha >= 0)]] = np.flatnonzero(kept & (sha >= 0))
        same = np.flatnonzero(sha >= 0)
        same = same[by_sha[sha[same]] >= 0]
        yield out(same, by_sha[sha[same]], "exact")
        owner = np.flatnonzero(kept & coded)
        there = code[owner]
        members = np.flatnonzero(coded)[np.argsort(code[coded], kind="stable")]
        start = np.searchsorted(code[members], np.arange(len(codes) + 1))
        for q, c in _pairs(codes, codes[there], radius):
            many = start[q + 1] - start[q]
            signature = members[np.arange(many.sum()) + np.repeat(start[q] - (np.cumsum(many) - many), many)]
            accepted = np.repeat(owner[c], many)
            apart = (sha[signature] < 0) | (sha[signature] != sha[accepted])
            if apart.any():
                yield out(signature[apart], accepted[apart], "near")

    return run
