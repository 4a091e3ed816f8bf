import random

import pytest

from skeinlake.operators import snapshot_diff
from skeinlake.operators.snapshot_diff import ENTRY_SNAPSHOTS, entry_changes

SCHEMA = "snapshotNo int, sourceEntryId string, lastSeenAt double, mtimeMs double, state string, fingerprint string, snap string, v int, bucket string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    latest = {}
    for s, i, seen, m, st, f in rows:
        if s is None or i is None:
            continue
        v = (seen, None if m is None else int(m // 1), st, None if f is None else f.lower())
        key = lambda v: tuple((x is not None, x) for x in v)
        if (s, i) not in latest or key(v) > key(latest[s, i]):
            latest[s, i] = v
    numbers, out = sorted({s for s, _ in latest}), set()
    for old, now in zip(numbers, numbers[1:]):
        a, b = ({i: v for (s, i), v in latest.items() if s == n} for n in (old, now))
        for i in a.keys() | b.keys():
            if i not in a or i not in b:
                out.add((now, i, "removed" if i in a else "added"))
            elif a[i][1:3] != b[i][1:3] or (a[i][3] != b[i][3] and a[i][3] and b[i][3]):
                out.add((now, i, "changed"))
    return out


def random_rows(seed, n, snapshots=(1, 2, 4)):
    r, rows = random.Random(seed), []
    for s in snapshots:
        for i in range(n):
            if r.random() < 0.85:
                rows.append((s, f"se_{i}", 1.0, float(i) + r.choice([0, 0, 0, 0.5, 1]), r.choice(["active"] * 9 + ["missing"]), r.choice(["Ab", "aB", None, "ab", "cd"])))
    rows += r.sample(rows, n // 10)  # repeated
    rows += [(1, None, 1.0, 1.0, "active", "x"), (None, "se_1", 1.0, 1.0, "active", "x"), (2, "se_0", 9.0, None, None, None)]
    return rows


def found(df):
    return {tuple(r) for r in df.select("snapshotNo", "sourceEntryId", "changeKind").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed, 300)
    assert found(entry_changes(rows_of(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_failed_buckets_are_enlarged_or_compared(spark, monkeypatch, rounds):
    """Tables far too small: recovered after enlarging, or row by row after the last round."""
    monkeypatch.setattr(snapshot_diff, "_per_bucket", lambda *a: 6)
    rows = random_rows(3, 200)
    from dataclasses import replace

    spec = replace(ENTRY_SNAPSHOTS, rounds=rounds, rows_per_bucket=128)
    got = snapshot_diff.changes(rows_of(spark, rows), spec).withColumnRenamed("key", "sourceEntryId")
    assert found(got) == brute(rows)


def test_empty_and_single_snapshot(spark):
    assert found(entry_changes(rows_of(spark, []))) == set()
    assert found(entry_changes(rows_of(spark, [(1, "a", 1.0, 1.0, "active", "f")]))) == set()


def test_one_key_with_a_third_of_all_rows(spark):
    rows = [(s, f"se_{i}", 1.0, 1.0, "active", "f") for s in (1, 2) for i in range(100)]
    rows += [(s, "se_hot", float(k), float(k), "active", "f") for s in (1, 2) for k in range(100 + s)]
    assert found(entry_changes(rows_of(spark, rows))) == {(2, "se_hot", "changed")}
