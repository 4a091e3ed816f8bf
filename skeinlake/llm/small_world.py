"""A navigable small-world graph over 64-bit codes under the Hamming distance, in numpy.

Codes are inserted in blocks: each is linked both ways with the nearest codes that a beam search
over the codes before it finds. Early codes have far neighbours, which later become the long links
that a search follows first. Searches walk many queries at once; every code whose distance was
computed and is within the radius is a hit, and a query with so many hits that they might have
filled its beam is searched again with a wider one, so hits are never cut off. Codes that even a
repaired graph doesn't lead to are kept in a list that every search compares one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Links a code makes when it is inserted, and the most it keeps of those that later codes make to it.
LINKS, BACK_LINKS = 12, 36
#: Beam width of insertions, queries walked at once, and nodes expanded per step.
BUILD_BEAM, CHUNK, STEP = 32, 512, 4
FAR = np.int64(1) << np.int64(40)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


@dataclass
class Graph:
    codes: np.ndarray  # uint64, n
    links: np.ndarray  # int32, n x width, -1 where empty
    beam: int = BUILD_BEAM
    #: Nodes that walks don't reach.
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    #: Part of the true hits of the sample queries that the beam found.
    recall: float = 1.0

    def pack(self) -> bytes:
        """Links as one byte string: each node's number of links, then all links."""
        held = self.links >= 0
        return held.sum(axis=1).astype("<u2").tobytes() + self.links[held].astype("<u4").tobytes()

    @classmethod
    def unpack(cls, codes: np.ndarray, packed: bytes, beam: int, rest: np.ndarray) -> Graph:
        n = len(codes)
        counts = np.frombuffer(packed, dtype="<u2", count=n).astype(np.int64)
        links = np.full((n, max(1, int(counts.max(initial=0)))), -1, dtype=np.int32)
        links[np.arange(links.shape[1])[None, :] < counts[:, None]] = np.frombuffer(packed, dtype="<u4", offset=2 * n)
        return cls(codes, links, beam, rest)


def _walk(codes: np.ndarray, links: np.ndarray, size: int, queries: np.ndarray, beam: int, radius: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each query its ``beam`` nearest found among the first ``size`` codes, as distance << 32 | node (FAR where fewer), and all hits as (query, node)."""
    q = len(queries)
    seen = np.zeros((q, size), dtype=bool)
    entries = np.unique(np.linspace(0, size - 1, min(size, 8)).astype(np.int64))
    seen[:, entries] = True
    d = distance(codes[entries][None, :], queries[:, None])
    hit_q, hit_n = np.nonzero(d <= radius)
    hits = [(hit_q, entries[hit_n])]
    best = np.full((q, beam), FAR, dtype=np.int64)
    first = np.sort((d << 32) | entries[None, :], axis=1)[:, :beam]
    best[:, : first.shape[1]] = first
    opened = best >= FAR  # nodes that were expanded; empty places count as such
    active = np.arange(q)
    while len(active):
        own, done = best[active], opened[active]
        order = np.argsort(np.where(done, FAR * 2, own), axis=1, kind="stable")[:, :STEP]
        picked = np.take_along_axis(own, order, axis=1)
        fresh = ~np.take_along_axis(done, order, axis=1)
        np.put_along_axis(done, order, True, axis=1)
        nodes = np.where(fresh, picked & 0xFFFFFFFF, 0)
        near = links[nodes].reshape(len(active), -1)
        valid = (near >= 0) & np.repeat(fresh, links.shape[1], axis=1)
        near = np.where(valid, near, 0)
        valid &= ~seen[active[:, None], near]
        seen[active[:, None], np.where(valid, near, entries[0])] = True
        dist = distance(codes[near], queries[active][:, None])
        at_q, at_n = np.nonzero(valid & (dist <= radius))
        if len(at_q):
            hits.append((active[at_q], near[at_q, at_n]))
        keys = np.sort(np.where(valid, (dist << 32) | near, FAR), axis=1)
        keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = FAR  # reached from two nodes at once
        together = np.concatenate([own, keys], axis=1)
        marks = np.concatenate([done, keys >= FAR], axis=1)
        keep = np.argpartition(together, beam - 1, axis=1)[:, :beam]
        own = np.take_along_axis(together, keep, axis=1)
        done = np.take_along_axis(marks, keep, axis=1)
        best[active], opened[active] = own, done
        active = active[~done.all(axis=1)]
    found_q = np.concatenate([h[0] for h in hits])
    found_n = np.concatenate([h[1] for h in hits])
    pairs = np.unique(np.stack([found_q, found_n], axis=1), axis=0) if len(found_q) else np.zeros((0, 2), dtype=np.int64)
    return np.sort(best, axis=1), (pairs[:, 0], pairs[:, 1])


def _link(links: np.ndarray, counts: np.ndarray, codes: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Add links target -> source; where a list is full, a farther back link gives way to a nearer one."""
    for s, t in zip(source, target):
        if counts[t] < links.shape[1]:
            links[t, counts[t]] = s
            counts[t] += 1
        else:
            back = links[t, LINKS:]
            away = distance(codes[back], codes[t])
            worst = int(np.argmax(away))
            if away[worst] > int(codes[s] ^ codes[t]).bit_count():
                links[t, LINKS + worst] = s


def build(codes: np.ndarray, radius: int, target_recall: float = 1.0, sample: int = 1024) -> Graph:
    """A graph of distinct codes; its beam is tuned on queries made from ``sample`` of them."""
    codes = np.asarray(codes, dtype=np.uint64)
    n = len(codes)
    width = LINKS + BACK_LINKS
    links = np.full((n, width), -1, dtype=np.int32)
    counts = np.zeros(n, dtype=np.int64)
    done = min(n, 128)
    if done > 1:
        d = distance(codes[:done, None], codes[None, :done])
        np.fill_diagonal(d, 1 << 20)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(LINKS, done - 1)]
        links[:done, : near.shape[1]] = near
        counts[:done] = near.shape[1]
    while done < n:
        block = np.arange(done, min(n, done + max(64, min(CHUNK, done // 2))))
        best, _ = _walk(codes, links, done, codes[block], BUILD_BEAM, -1)
        near = best[:, :LINKS]
        # Codes of one block don't see each other in the walk; those close together are linked directly.
        inside = distance(codes[block][:, None], codes[block][None, :])
        inside = np.where(np.arange(len(block))[None, :] < np.arange(len(block))[:, None], (inside << 32) | block[None, :], FAR)
        near = np.sort(np.concatenate([near, np.sort(inside, axis=1)[:, :LINKS]], axis=1), axis=1)[:, :LINKS]
        links[block, : near.shape[1]] = np.where(near < FAR, near & 0xFFFFFFFF, -1)
        counts[block] = LINKS
        source = np.repeat(block, near.shape[1])[(near < FAR).ravel()]
        target = (near & 0xFFFFFFFF)[near < FAR].ravel()
        _link(links, counts, codes, source, target)
        done = block[-1] + 1
    graph = Graph(codes, links)
    _repair(graph)
    graph.beam, graph.recall = _tune(graph, radius, target_recall, sample)
    return graph


def _repair(graph: Graph, rounds: int = 8) -> None:
    """Codes that a search for themselves doesn't find get a link from the nearest code that it does find.

    Those still lost after the last round, which new links may have hidden, go to ``rest``.
    """
    n = len(graph.codes)
    for turn in range(rounds + 1):
        lost: list[tuple[int, int]] = []
        for start in range(0, n, CHUNK):
            at = np.arange(start, min(n, start + CHUNK))
            best, (hit_q, hit_n) = _walk(graph.codes, graph.links, n, graph.codes[at], BUILD_BEAM, 0)
            missing = np.setdiff1d(at, at[hit_q])
            lost += [(int(m), int(best[m - start, 0] & 0xFFFFFFFF)) for m in missing]
        if not lost:
            return
        if turn == rounds:
            graph.rest = np.array(sorted(m for m, _ in lost), dtype=np.int64)
            return
        extra: dict[int, list[int]] = {}
        for m, t in lost:
            extra.setdefault(t, []).append(m)
        more = np.full((n, max(map(len, extra.values()))), -1, dtype=np.int32)
        for t, ms in extra.items():
            more[t, : len(ms)] = ms
        graph.links = np.concatenate([graph.links, more], axis=1)


def _tune(graph: Graph, radius: int, target_recall: float, sample: int) -> tuple[int, float]:
    """Half as wide again as the narrowest beam that finds what an exhaustive search finds, and the part that one found."""
    n = len(graph.codes)
    rng = np.random.default_rng(n)
    chosen = rng.choice(n, size=min(n, sample), replace=False)
    queries = graph.codes[chosen].copy()
    for i in range(radius):
        queries ^= np.where(rng.random(len(queries)) < 0.75, np.uint64(1) << rng.integers(0, 64, len(queries)).astype(np.uint64), np.uint64(0))
    truth = {(int(i), int(j)) for i, j in zip(*np.nonzero(distance(queries[:, None], graph.codes[None, :]) <= radius))}
    beam = BUILD_BEAM // 2
    while True:
        got = {(int(i), int(j)) for i, j in zip(*search(graph, queries, radius, beam))}
        if beam >= n or len(got) >= target_recall * len(truth):
            return beam * 3 // 2, len(got) / max(1, len(truth))
        beam = beam * 3 // 2


def search(graph: Graph, queries: np.ndarray, radius: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (query, node) within ``radius``, found with the graph's beam or the given one."""
    n = len(graph.codes)
    if not n or not len(queries):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    beam = min(beam or graph.beam, n)
    out_q, out_n = [], []
    chunk = max(1, min(CHUNK, (1 << 26) // max(1, n)))
    pending = [(np.arange(s, min(len(queries), s + chunk)), beam) for s in range(0, len(queries), chunk)]
    while pending:
        at, wide = pending.pop()
        _, (hit_q, hit_n) = _walk(graph.codes, graph.links, n, queries[at], wide, radius)
        crowded = np.bincount(hit_q, minlength=len(at)) >= wide // 2
        if wide < n and crowded.any():
            pending.append((at[crowded], min(n, wide * 4)))
            keep = ~crowded[hit_q]
            hit_q, hit_n = hit_q[keep], hit_n[keep]
        out_q.append(at[hit_q])
        out_n.append(hit_n)
    if not len(graph.rest):
        return np.concatenate(out_q), np.concatenate(out_n)
    for start in range(0, len(queries), chunk):
        hit_q, hit_r = np.nonzero(distance(graph.codes[graph.rest][None, :], queries[start : start + chunk, None]) <= radius)
        out_q.append(hit_q + start)
        out_n.append(graph.rest[hit_r])
    pairs = np.unique(np.stack([np.concatenate(out_q), np.concatenate(out_n)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]
