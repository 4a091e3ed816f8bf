"""Plain single-process versions of the corpus queries, over rows as dictionaries."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict

from skeinlake.llm.lookalikes import ONE, SEVERAL


def form(text: str) -> str:
    return unicodedata.normalize("NFC", "".join({**ONE, **SEVERAL}.get(c, c) for c in text))


def p9(documents: list[dict]) -> set[tuple]:
    by = defaultdict(list)
    for d in documents:
        if d["text"] is not None:
            by[form(d["text"])].append((d["doc_id"], d["text"]))
    return {(min(a, b), max(a, b)) for g in by.values() for a, s in g for b, t in g if s != t}


def p7(documents: list[dict], items: list[dict], n: int = 12) -> set[tuple]:
    words = lambda t: re.findall(r"[^\W_]+", form(t).lower())
    grams = defaultdict(set)
    for i in items:
        w = words(i["text"])
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i["item_id"])
    out = set()
    for d in documents:
        w = words(d["text"] or "")
        for k in range(len(w) - n + 1):
            out |= {(d["doc_id"], i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def p6(links: list[dict], media: list[dict]) -> set[tuple]:
    out = set()
    order = ["exact", "strong", "probable"]
    own = {(m["mediaId"], m["sourceEntryId"]) for m in media}
    for at, level in enumerate(order):
        pairs = {
            (x["mediaId"], x["sourceEntryId"])
            for x in links
            if x["level"] is not None and x["level"].strip().lower() in order[: at + 1] and x["mediaId"] and x["sourceEntryId"]
        }
        left, right = {a for a, _ in pairs}, {b for _, b in pairs}
        pairs |= {(a, b) for a, b in own if a in left or b in right}
        parent: dict[str, str] = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        out |= {(level, x, root(x)) for x in list(parent)}
    return out


def p4(quarantine: list[dict], media: list[dict], metadata: list[dict], instant: dict) -> set[tuple]:
    """``instant``: takenAt, tzName -> epoch ms or None."""
    size, current, out = {}, {}, set()
    for m in media:
        if m["mediaId"]:
            size[m["mediaId"]] = max(size.get(m["mediaId"]) or 0, m["size"] or 0)
    for m in metadata:
        if m["mediaId"] not in current or m["extractedAt"] > current[m["mediaId"]]["extractedAt"]:
            current[m["mediaId"]] = m
    listed = defaultdict(set)
    for q in quarantine:
        listed[q["quarantineId"]] |= {c.strip() for c in q["candidateMediaIds"] or [] if c and c.strip() in size}

    def trust(c):
        m = current.get(c)
        if m is None:
            return (1, float("inf"), c)
        try:
            raw = json.loads(m["raw"])
        except (TypeError, ValueError):
            raw = None
        good = isinstance(raw, dict) and raw.get("extractor") in ("exiftool", "ffprobe")
        return (0 if good else 1, -m["extractedAt"].timestamp(), c)

    for q, candidates in listed.items():
        usable = {}
        for c in candidates:
            m = current.get(c) or {}
            usable[c] = {
                "size": size[c] > 0,
                "takenAt": instant.get((m.get("takenAt"), m.get("tzName"))) is not None,
                "cameraModel": bool((m.get("cameraModel") or "").strip()),
                "width": (m.get("width") or 0) > 0,
            }
        for f in ("size", "takenAt", "cameraModel", "width"):
            can = [c for c in candidates if usable[c][f]]
            if can:
                out.add((q, f, min(can, key=(lambda c: (-size[c], c)) if f == "size" else trust)))
        if any(any(u.values()) for u in usable.values()):
            out.add((q, "record", min(candidates, key=lambda c: (-sum(usable[c].values()), trust(c)))))
    return out


def p2(media: list[dict], metadata: list[dict], radius: int = 4) -> set[tuple]:
    import numpy as np

    batch, sha, current = {}, {}, {}
    for m in media:
        i = m["mediaId"]
        batch[i] = min(batch.get(i, m["batchNo"]), m["batchNo"])
        s = (m["sha256"] or "").strip().lower()
        if re.fullmatch("[0-9a-f]{64}", s):
            sha[i] = s
    for m in metadata:
        if m["mediaId"] not in current or m["extractedAt"] > current[m["mediaId"]]["extractedAt"]:
            current[m["mediaId"]] = m
    code = {}
    for i, m in current.items():
        try:
            h = json.loads(m["raw"]).get("perceptualHash")
        except (TypeError, ValueError, AttributeError):
            continue
        if isinstance(h, str) and re.fullmatch("[0-9a-f]{16}", h.strip().lower()):
            code[i] = int(h.strip(), 16)
    out, by_sha, ids, codes, n = set(), defaultdict(list), [], np.zeros(len(batch), dtype=np.uint64), 0
    for i in sorted(batch, key=lambda i: (batch[i], i)):
        hits = {}
        if i in code:
            for j in np.nonzero(np.bitwise_count(codes[:n] ^ np.uint64(code[i])) <= radius)[0]:
                hits[ids[j]] = "near"
        for j in by_sha[sha[i]] if i in sha else ():
            hits[j] = "exact"
        if hits:
            out |= {(min(i, j), max(i, j), k) for j, k in hits.items()}
            continue
        if i in sha:
            by_sha[sha[i]].append(i)
        if i in code:
            ids.append(i)
            codes[n] = code[i]
            n += 1
    return out
