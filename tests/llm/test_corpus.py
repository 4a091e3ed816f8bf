import random
from collections import Counter
from datetime import datetime

import brute
import numpy as np
import pytest

from skeinlake.llm import groups, history_index, leaks, lookalikes, mixing, queries, small_world, survivors
from skeinlake.operators import instants
from skeinlake.plans.staging import Workspace
from skeinlake.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, id int, form string, variant int"


def dicts(spark, name):
    return [r.asDict(recursive=True) for r in table(spark, FOLDER, name).collect()]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "f", 2) for i, t, s in rows], DOCS)


def tuples(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


# Whole tables against plain versions


def test_p2(spark):
    assert tuples(queries.p2_found(spark, FOLDER)) == brute.p2(dicts(spark, "media"), dicts(spark, "media_metadata"))


def test_p4(spark):
    taken = table(spark, FOLDER, "media_metadata").select("takenAt", "tzName").distinct()
    known = {(r.takenAt, r.tzName): r.instantMs for r in instants.normalise(taken, "takenAt", "tzName", "tzName").collect()}
    assert tuples(queries.p4_found(spark, FOLDER)) == brute.p4(dicts(spark, "quarantine_item"), dicts(spark, "media"), dicts(spark, "media_metadata"), known)


def test_p6(spark):
    assert tuples(queries.p6_found(spark, FOLDER)) == brute.p6(dicts(spark, "duplicate_link"), dicts(spark, "media"))


def test_p7_and_p9(spark):
    rows = dicts(spark, "documents")
    assert tuples(queries.p7_found(spark, FOLDER)) == brute.p7(rows, dicts(spark, "eval_item"))
    assert tuples(queries.p9_found(spark, FOLDER)) == brute.p9(rows)


# Look-alikes


def test_lookalikes(spark):
    same = ["résumé café", "résumé café", "résumé café", "ｒésumé сafé", "rés​umé café"]
    apart = ["resume cafe", "Résumé café", "résumé  café", "résumé café.", "résumé²", "résumé 1", "résumé ١", "résumé2"]
    rows = [(i, t, None) for i, t in enumerate(same + apart)] + [(50, None, None), (51, "", None), (52, "", None), (53, same[0], None), (None, "x", None), (54, "Ёлка ў", None), (55, "Ёлка ў", None)]
    pairs = tuples(lookalikes.lookalike_pairs(docs(spark, rows)))
    assert pairs == {(a, b) for a in range(5) for b in range(a + 1, 5)} | {(i, 53) for i in range(1, 5)} | {(54, 55)}
    assert pairs == brute.p9([{"doc_id": i, "text": t} for i, t, _ in rows if i is not None])
    canonical = dict(tuples(lookalikes.canonical_members(docs(spark, rows))))
    assert canonical[53] == 0 and canonical[4] == 0 and canonical[5] == 5 and canonical[52] == 51 and canonical[55] == 54 and 50 not in canonical
    assert tuples(lookalikes.lookalike_pairs(docs(spark, []))) == set()


# Leaks

ITEM = " ".join(f"w{i}" for i in range(20))
ITEMS = "item_id bigint, text string, doc_id int"


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (2, "other " + " ".join(f"w{i}" for i in range(3, 16)), 0), (3, "short one", 0), (4, None, 0), (5, "", 0), (1, ITEM, 0)], ITEMS)
    long_text = "pad " * 50_000 + ITEM.upper().replace(" ", " -- ")
    rows = [
        (1, ITEM, None), (2, " ".join(ITEM.split()[:11]), None), (3, long_text, None), (4, " ".join(ITEM.split()[5:17]), None),
        (5, ITEM.replace("w", "\uff57") + " x", None), (6, None, None), (7, "", None), (8, " ".join(ITEM.split()[:11] + ["zz"] + ITEM.split()[11:]), None), (9, "a short one b", None),
    ]
    found = leaks.leaks(docs(spark, rows), items, "doc_id", "text", "item_id", "text").collect()
    got = {(r["id"], r["item"]): (r["words"], r["longest"], r["coverage"]) for r in found}
    assert got == {(d, 1): (20, 20, 1.0) for d in (1, 3, 5)} | {(d, 2): (13, 13, 13 / 14) for d in (1, 3, 5)} | {(4, 1): (12, 12, 0.6)}
    short = leaks.leaks(docs(spark, rows), items, "doc_id", "text", "item_id", "text", min_coverage=1.0)
    assert (9, 3) in {(r["id"], r["item"]) for r in short.collect()}
    split = leaks.leaks(docs(spark, rows), items, "doc_id", "text", "item_id", "text", words_per_automaton=5)
    assert {(r["id"], r["item"]) for r in split.collect()} == set(got)
    kept = {r["doc_id"]: (r["text"], r["removed_words"]) for r in leaks.remove_spans(docs(spark, rows), items, "doc_id", "text", "item_id", "text").collect()}
    assert kept[2] == (rows[1][1], 0) and kept[6] == (None, 0) and kept[5][0].strip() == "x" and kept[3][1] == 20 and "W" not in kept[3][0]
    assert leaks.leaks(docs(spark, rows), spark.createDataFrame([], ITEMS), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.leaks(docs(spark, []), items, "doc_id", "text", "item_id", "text").count() == 0


def test_automaton_equals_grams():
    r = random.Random(5)
    for _ in range(40):
        items = [(i, [r.choice("abc") for _ in range(r.randrange(1, 30))]) for i in range(4)]
        text = [r.choice("abcd") for _ in range(200)]
        automaton = leaks.build(items, 4)
        want = {i for i, t in items for k in range(len(t) - 3) for j in range(len(text) - 3) if t[k : k + 4] == text[j : j + 4]}
        assert set(leaks.scan(automaton, text)) == want


# Groups


def test_groups(spark):
    r = random.Random(2)
    chain = [("x", f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    star = [("x", "hub", f"leaf{i}") for i in range(120)]
    noise = [("y", f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(50)]
    rows = chain + star + noise + chain[:5] + [("x", None, "a"), (None, "a", "b"), ("y", "self", "self")]
    r.shuffle(rows)
    got = tuples(groups.groups(spark.createDataFrame(rows, "scope string, a string, b string")))
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for s, a, b in rows:
        if s and a and b:
            x, y = sorted((root((s, a)), root((s, b))))
            parent[y] = x
    assert got == {(*v, root(v)[1]) for v in list(parent)}
    assert tuples(groups.groups(spark.createDataFrame([], "scope string, a string, b string"))) == set()


# Survivors


def test_search_respects_dependencies():
    option = lambda rank, c, city, code: ((rank, 0, 0, c), c, {"city": city, "zip": code})
    options = {"city": [option(0, "a", "Rome", None), option(1, "b", "Oslo", "1")], "zip": [option(0, "b", "Oslo", "1"), option(1, "c", "Rome", "2"), option(2, "d", "Rome", "3")]}
    assert survivors.search(options, []) == {"city": "a", "zip": "b"}
    best = survivors.search(options, [survivors.Dependency("city", "zip")])
    assert best in ({"city": "a", "zip": "c"}, {"city": "b", "zip": "b"})
    r = random.Random(1)
    for _ in range(60):
        opts = {n: [option(k, f"{n}{k}", r.choice("xy"), r.choice(["1", "2", None])) for k in range(4)] for n in ("city", "zip")}
        rule = survivors.Dependency("city", "zip")
        pairs = {}
        for n in opts:
            for _, _, v in opts[n]:
                if v["zip"]:
                    pairs.setdefault(v["city"], set()).add(v["zip"])
        costs = [
            i + j for i, x in enumerate(opts["city"]) for j, y in enumerate(opts["zip"])
            if not pairs.get(x[2]["city"]) or y[2]["zip"] in pairs[x[2]["city"]]
        ]
        got = survivors.search(opts, [rule])
        if costs:
            assert sum(int(c[-1]) for c in got.values()) == min(costs)


def test_choose_with_dependency(spark):
    rows = [("g", "a", "Rome", None, 0), ("g", "b", "Oslo", "1", 1), ("g", "c", "Rome", "2", 2), ("h", "z", None, None, 0)]
    df = spark.createDataFrame(rows, "grp string, candidate string, city string, code string, age int")
    bundles = [survivors.Bundle("city", "city is not null", ("0", "0", "age"), "city"), survivors.Bundle("zip", "code is not null", ("0", "0", "age"), "code")]
    free = tuples(survivors.choose(df, bundles))
    assert free == {("g", "city", "a"), ("g", "zip", "b")}
    bound = tuples(survivors.choose(df, bundles, [survivors.Dependency("city", "zip")]))
    assert bound in ({("g", "city", "a"), ("g", "zip", "c")}, {("g", "city", "b"), ("g", "zip", "b")})


# History


MEDIA = "mediaId string, sha256 string, batchNo int, batch int, code string"
META = "mediaId string, raw string, extractedAt timestamp, sha string"


def history(seed, n, batches=5):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 3)]
    media, meta = [], []
    for i in range(n):
        code = r.choice(base[: 1 + len(base) // (1 + i % 2)]) if i % 3 else base[0]  # a third look like one image
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 6])):
            code ^= 1 << r.randrange(64)
        sha = r.choice([None, f"{i:064x}", f"{i % 11:064X} ", "bad"])
        media += [(f"m{i:04d}", sha, r.randrange(1, batches + 1), 0, "c")] * r.choice([1, 1, 2])
        raw = r.choice([f'{{"perceptualHash": " {code:016X}"}}'] * 6 + ["{cut", None, '{"perceptualHash": "n/a"}'])
        meta.append((f"m{i:04d}", raw, datetime(2024, 1, 1), "s"))
    return media, meta


def named(media, meta):
    return [dict(zip(("mediaId", "sha256", "batchNo"), m)) for m in media], [dict(zip(("mediaId", "raw", "extractedAt"), m)) for m in meta]


@pytest.mark.parametrize(("capacity", "sent"), [(8192, 1 << 25), (16, 0)])
def test_history(spark, capacity, sent, monkeypatch):
    """One shard a segment sent to the queries, and many, placed by slices of the bits, joined with them; two compactions."""
    media, meta = history(1, 300)
    monkeypatch.setattr(history_index, "SENT_BYTES", sent)
    got = history_index.repeated_media(spark.createDataFrame(media, MEDIA), spark.createDataFrame(meta, META), capacity=capacity, fan_in=2)
    assert tuples(got) == brute.p2(*named(media, meta))


def test_history_empty(spark):
    assert tuples(history_index.repeated_media(spark.createDataFrame([], MEDIA), spark.createDataFrame([], META))) == set()
    only = spark.createDataFrame([("a", None, 1, 0, "c"), ("b", None, None, 0, "c"), (None, "x", 1, 0, "c")], MEDIA)
    assert tuples(history_index.repeated_media(only, spark.createDataFrame([], META))) == set()


BATCH = "node string, sha string, code long"


def test_another_session_continues_the_index(spark, tmp_path):
    index = history_index.HistoryIndex(spark, str(tmp_path), fan_in=3)
    for k in range(4):
        rows = [(f"{k}|{i:03d}", None, i << 32 | i << 8 if i % 2 else 77 << 40 | i << 10 | i << 50) for i in range(40 * k, 40 * k + 60)]
        index.add(k, spark.createDataFrame(rows, BATCH))
    again = history_index.HistoryIndex(spark, str(tmp_path))
    held = again.manifest()
    assert held.batches == [0, 1, 2, 3] and [s.level for s in held.segments] == [1, 0]  # the first three were compacted
    assert all(r["recall"] >= 0.9 and r["codes"] > 0 for r in again.recall().collect())
    with pytest.raises(ValueError):
        again.add(3, spark.createDataFrame([], BATCH))
    again.add(4, spark.createDataFrame([("4|000", "s", 3 << 32 | 3 << 8 | 1), ("4|001", "s", None), ("4|002", None, None)], BATCH))
    # 4|000 is within the radius of 0|001; 4|001 has its digest and, coming later, is new.
    code = (3 << 32) + (3 << 8) + 1
    assert {tuple(r)[1:] for r in again.matches().where("batch = 4").collect()} == {("s", code, "0|001", "near"), ("s", code, "4|001", "exact"), ("s", None, "4|001", "exact")}
    stale = history_index.HistoryIndex(spark, str(tmp_path))
    stale.manifest = lambda: held
    with pytest.raises(FileExistsError):
        stale.add(5, spark.createDataFrame([("5|000", "t", None)], BATCH))
    assert history_index.HistoryIndex(spark, str(tmp_path)).manifest().batches == [0, 1, 2, 3, 4] and again.recall().count() >= 2


def test_codes_that_walks_miss_are_compared_one_by_one():
    codes = np.arange(40, dtype=np.uint64) << np.uint64(20)
    graph = small_world.build(codes, 4)
    graph.links[:] = -1
    small_world._repair(graph, rounds=0)
    assert len(graph.rest)
    graph = small_world.Graph.unpack(graph.codes, graph.pack(), graph.beam, graph.rest)
    q, n = small_world.search(graph, codes, 0)
    assert q.tolist() == n.tolist() == list(range(40))


def test_graph_recall():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    cluster = codes[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # 64 codes around one
    codes = np.unique(np.concatenate([codes, cluster]))
    rng.shuffle(codes)
    graph = small_world.build(codes, 4)
    queries_ = codes.copy()
    for _ in range(4):
        queries_ ^= np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64)
    got = set(zip(*(x.tolist() for x in small_world.search(graph, queries_, 4))))
    truth = {(int(i), int(j)) for i, j in zip(*np.nonzero(small_world.distance(queries_[:, None], codes[None, :]) <= 4))}
    assert got <= truth and len(got) >= 0.995 * len(truth)
    for n in (0, 1, 2, 5):
        small = small_world.build(codes[:n], 4)
        assert len(small_world.search(small, codes[:n], 0)[0]) == n


# Mixing


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 500, 800).astype(float)
    p = np.full(800, 0.37)
    flown = mixing.fly(p, tokens, rng)
    assert ((flown > 1e-9) & (flown < 1 - 1e-9)).sum() <= 2
    assert abs(flown.sum() - p.sum()) < 1e-6 and abs((flown * tokens).sum() - (p * tokens).sum()) < 1e-3
    landed = mixing.land(p, tokens, rng)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - p.sum()) <= 1 and abs((landed * tokens).sum() - (p * tokens).sum()) <= 1000
    mean = np.mean([mixing.land(np.full(6, 0.5), tokens[:6], np.random.default_rng(k)) for k in range(600)], axis=0)
    assert (abs(mean - 0.5) < 0.1).all()
    assert len(mixing.land(np.zeros(0), np.zeros(0), rng)) == 0


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, "word " * r.randrange(1, 60), r.choice(["Big ", "big", "big", "small"]) if i % 10 else "other") for i in range(900)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None)]
    targets = spark.createDataFrame([(" BIG", 2.0, 1), ("small", 3.0, 2), ("none", 1.0, 3), (None, 1.0, 1), ("other", 0.0, 1)], "source string, weight double, max_repeats int")
    mixed, report = mixing.mix(docs(spark, rows), targets)
    copies = mixed.collect()
    assert max(Counter(r["id"] for r in copies).values()) == 1 and {r["source"] for r in copies} == {"big", "small"}
    got = {r["source"]: r for r in report.collect()}
    assert got["none"]["tokens_used"] == 0 and got["small"]["most_copies"] <= 2 and got["big"]["most_copies"] <= 1
    assert abs(got["small"]["actual_share"] / got["big"]["actual_share"] - 1.5) < 0.02
    assert abs(sum(r["wanted_share"] for r in got.values()) - 1) < 1e-9
    empty, shares = mixing.mix(docs(spark, []), targets)
    assert empty.count() == 0 and {r["actual_share"] for r in shares.collect()} == {0.0}
    assert mixing.mix(docs(spark, rows), targets.limit(0))[0].count() == 0


def test_blocks_fly_again(spark):
    df = spark.createDataFrame([(i, "s", 1 + i * 7 % 100, 0.4) for i in range(3000)], "id bigint, source string, tokens bigint, p double")
    out = mixing.balanced_extras(df, Workspace(spark, "t"), seed=1, block=200).collect()
    assert len(out) == 3000 and {r["p"] for r in out} == {0.0, 1.0}
    assert abs(sum(r["p"] for r in out) - 1200) <= 1
    assert abs(sum(r["p"] * r["tokens"] for r in out) - 0.4 * sum(r["tokens"] for r in out)) <= 200
