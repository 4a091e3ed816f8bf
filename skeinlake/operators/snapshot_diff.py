"""What was added, removed or changed between consecutive full snapshots.

Every row of a snapshot becomes a pair (hash of its key, hash of its compared
fields). The pairs of one hash bucket of one snapshot go into an invertible Bloom
lookup table: each pair is added to three cells that hold a count and the XOR of
key hashes, value hashes and pair checks. The tables of neighbouring snapshots are
subtracted, so that pairs they share vanish, and the rest is peeled: a cell with
one pair left reveals it, and removing it from its other cells reveals more. A
bucket that cannot be emptied, or whose digest does not agree with what was
recovered, is encoded again in a larger table; what still fails after the last
size is compared row by row.

Tables are sized from the number of differences, not of rows, so what is shuffled
between snapshots grows with the changes. The number of differences is estimated
from the pairs in one of 64 hash classes; the estimate affects only how often a
table must be enlarged, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.hashing import xxhash64
from skeinlake.plans.sizing import power_of_two
from skeinlake.plans.staging import Workspace

#: Cells a pair is added to.
WAYS = 3
#: Seeds of the digest and of the cells' positions.
DIGEST_SEED = 7
POSITION_SEED = 101
ELEMENTS = "pair int, bucket int, kh long, vh long, sign int, ok boolean"


@dataclass(frozen=True)
class SnapshotSpec:
    """The columns of a snapshot table.

    ``exact`` are compared with nulls equal to each other, ``lenient`` ones count as
    different only where both sides are present. All are SQL expressions; ``lenient``
    ones must be strings.
    """

    snapshot: str
    key: str
    order: str
    exact: dict[str, str]
    lenient: dict[str, str]
    rows_per_bucket: int = 1 << 15
    rounds: int = 4
    growth: int = 4


def current_rows(snapshots: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """One row per snapshot and key: the one with the greatest ``order`` (ties: greatest fields).

    Rows without snapshot number or key are dropped. Repeated rows are reduced before the shuffle.
    """
    fields = [F.expr(e).alias(n) for n, e in spec.exact.items()]
    fields += [F.unhex(F.md5(F.expr(e))).alias(n) for n, e in spec.lenient.items()]
    rows = snapshots.select(
        F.expr(spec.snapshot).cast("int").alias("snap"),
        F.expr(spec.key).alias("key"),
        F.struct(F.expr(spec.order).alias("o"), *fields).alias("v"),
    ).where("snap is not null and key is not null")
    return rows.groupBy("snap", "key").agg(F.max("v").alias("v")).select("snap", "key", "v.*").drop("o")


def _hashed(rows: DataFrame, spec: SnapshotSpec, buckets: int) -> DataFrame:
    names = [*spec.exact, *spec.lenient]
    present = [F.col(n).isNotNull() for n in names]
    kh = F.xxhash64("key")
    return rows.select(
        "*",
        kh.alias("kh"),
        F.xxhash64(*names, *present).alias("vh"),
        F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(buckets)).cast("int").alias("bucket"),
    )


def _with_pairs(cells: DataFrame, numbers: list[int]) -> DataFrame:
    """Each cell once for the comparison it ends and once, negated, for the one it begins."""
    later = dict(zip(numbers, numbers[1:]))
    begins = F.create_map(*[F.lit(x) for kv in later.items() for x in kv]) if later else None
    starts = F.lit(None).cast("int") if begins is None else F.try_element_at(begins, F.col("snap"))
    first = F.when(F.col("snap") != F.lit(numbers[0]), F.col("snap"))
    sides = F.array(
        F.struct(first.alias("pair"), F.lit(1).alias("sign")),
        F.struct(starts.alias("pair"), F.lit(-1).alias("sign")),
    )
    return cells.select("*", F.inline(sides)).where("pair is not null")


def encode(pairs: DataFrame, width: int, attempt: int) -> DataFrame:
    """Cells of the tables by snapshot and bucket; cell -1 is the bucket's digest.

    ``width`` cells for each of the three positions; ``attempt`` varies the positions.
    """
    positions: list[Column] = [
        (F.pmod(F.xxhash64("kh", "vh", F.lit(POSITION_SEED + WAYS * attempt + i).cast("long")), F.lit(width)) + i * width).cast("int")
        for i in range(WAYS)
    ]
    spread = pairs.select(
        "snap", "bucket", "kh", "vh",
        F.xxhash64("kh", "vh").alias("check"),
        F.xxhash64("kh", "vh", F.lit(DIGEST_SEED).cast("long")).alias("digest"),
        F.explode(F.array(*positions, F.lit(-1))).alias("cell"),
    )
    return spread.groupBy("snap", "bucket", "cell").agg(
        F.count("*").alias("n"),
        F.bit_xor("kh").alias("kx"),
        F.bit_xor("vh").alias("vx"),
        F.bit_xor(F.when(F.col("cell") == -1, F.col("digest")).otherwise(F.col("check"))).alias("cx"),
    )


def subtract(cells: DataFrame, numbers: list[int]) -> DataFrame:
    """Cells of each snapshot minus those of the one before; empty cells are dropped."""
    return (
        _with_pairs(cells, numbers)
        .groupBy("pair", "bucket", "cell")
        .agg(
            F.sum(F.col("n") * F.col("sign")).alias("n"),
            F.bit_xor("kx").alias("kx"),
            F.bit_xor("vx").alias("vx"),
            F.bit_xor("cx").alias("cx"),
        )
        .where("n <> 0 or kx <> 0 or vx <> 0 or cx <> 0")
    )


def peel(cells: pd.DataFrame, width: int, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Key hashes, value hashes and signs of the pairs in one subtracted table, and whether all were found."""
    size = WAYS * width
    n, kx, vx, cx = (np.zeros(size, dtype=np.int64) for _ in range(4))
    own = cells[cells["cell"] >= 0]
    at = own["cell"].to_numpy()
    n[at], kx[at], vx[at], cx[at] = (own[c].to_numpy() for c in ("n", "kx", "vx", "cx"))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = at
    while len(look):
        look = look[np.abs(n[look]) == 1]
        look = look[xxhash64(kx[look], vx[look]) == cx[look]] if len(look) else look
        if not len(look):
            break
        pure = np.unique(np.stack([kx[look], vx[look], n[look]], axis=1), axis=0)
        k, v, s = pure[:, 0], pure[:, 1], pure[:, 2]
        found.append((k, v, s))
        c = xxhash64(k, v)
        touched = []
        for i in range(WAYS):
            p = np.mod(xxhash64(k, v, POSITION_SEED + WAYS * attempt + i), width) + i * width
            np.subtract.at(n, p, s)
            for cell, x in ((kx, k), (vx, v), (cx, c)):
                np.bitwise_xor.at(cell, p, x)
            touched.append(p)
        look = np.unique(np.concatenate(touched))
        if sum(len(f[0]) for f in found) > 2 * size:
            return k[:0], v[:0], s[:0], False
    k, v, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    empty = not (n.any() or kx.any() or vx.any() or cx.any())
    total = cells[cells["cell"] == -1]
    digest = np.bitwise_xor.reduce(xxhash64(k, v, DIGEST_SEED)) if len(k) else 0
    expected = (0, 0) if total.empty else (int(total["n"].iloc[0]), int(total["cx"].iloc[0]))
    return k, v, s, empty and (int(s.sum()), int(digest)) == expected


def _peeler(width: int, attempt: int):
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        k, v, s, ok = peel(cells, width, attempt)
        if not ok:
            k, v, s = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        return pd.DataFrame({"pair": key[0], "bucket": key[1], "kh": k, "vh": v, "sign": s, "ok": ok})

    return run


def _per_bucket(rows: DataFrame, numbers: list[int], buckets: int) -> int:
    """Differences a bucket may have, from the pairs in one of 64 hash classes."""
    part = rows.where(F.pmod("kh", F.lit(64)) == 0).select("snap", "kh", "vh", F.lit(1).alias("n"))
    by_pair = (
        _with_pairs(part, numbers).groupBy("pair", "kh", "vh").agg(F.sum("sign").alias("n")).where("n <> 0").groupBy("pair").count()
    )
    most = by_pair.agg(F.max("count")).first()[0] or 0
    mean = 64 * (most + 2 * math.sqrt(most) + 1) / buckets
    return math.ceil(mean + 4 * math.sqrt(mean) + 8)


def changes(snapshots: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """snapshotNo, key, changeKind (added, removed, changed) of each snapshot against the one before it.

    The first snapshot is compared with nothing and yields no rows; an empty table yields none.
    Snapshots are consecutive in the order of their numbers, whatever numbers are missing.
    """
    spark = snapshots.sparkSession
    empty = spark.createDataFrame([], "snapshotNo int, key string, changeKind string")
    total = snapshots.count()
    buckets = power_of_two(total / spec.rows_per_bucket)
    work = Workspace(spark, "snapshot-diff")
    # Files hold whole buckets, so that each task's partial aggregation meets few cells.
    rows = work.save(_hashed(current_rows(snapshots, spec), spec, buckets).repartition("bucket"), "rows")
    numbers = sorted(r[0] for r in rows.select("snap").distinct().collect())
    if len(numbers) < 2:
        return empty

    width = math.ceil(1.5 * _per_bucket(rows, numbers, buckets) / WAYS)
    source, recovered, failed = rows.select("snap", "bucket", "kh", "vh"), [], None
    for attempt in range(spec.rounds):
        tables = subtract(encode(source, width, attempt), numbers)
        if failed is not None:
            tables = tables.join(failed, ["pair", "bucket"], "left_semi")
        found = work.save(tables.groupBy("pair", "bucket").applyInPandas(_peeler(width, attempt), ELEMENTS), f"found{attempt}")
        recovered.append(found.where("ok"))
        failed = found.where("not ok").select("pair", "bucket").distinct()
        if failed.isEmpty():
            failed = None
            break
        source = rows.select("snap", "bucket", "kh", "vh").join(failed.select("bucket").distinct(), "bucket", "left_semi")
        width *= spec.growth

    previous = dict(zip(numbers[1:], numbers))
    before = F.create_map(*[F.lit(x) for kv in previous.items() for x in kv])
    elements = recovered[0]
    for more in recovered[1:]:
        elements = elements.unionByName(more)
    elements = elements.select(
        "pair", "sign", "kh", "vh", F.when(F.col("sign") > 0, F.col("pair")).otherwise(F.try_element_at(before, F.col("pair"))).alias("snap")
    )
    sides = elements.join(rows.drop("bucket"), ["snap", "kh", "vh"]).drop("kh", "vh")
    if failed is not None:
        rest = _with_pairs(rows, numbers).join(failed, ["pair", "bucket"], "left_semi").drop("bucket", "kh", "vh")
        sides = sides.unionByName(rest)
    return classify(sides, spec)


def classify(sides: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Kinds of change from the recovered rows of both sides (sign 1: the later snapshot)."""
    names = [*spec.exact, *spec.lenient]
    both = sides.groupBy("pair", "key").agg(
        F.max(F.when(F.col("sign") > 0, F.struct(*names))).alias("now"),
        F.max(F.when(F.col("sign") < 0, F.struct(*names))).alias("old"),
    )
    differs = F.lit(False)
    for n in spec.exact:
        differs |= ~F.col(f"now.{n}").eqNullSafe(F.col(f"old.{n}"))
    for n in spec.lenient:
        differs |= F.coalesce(F.col(f"now.{n}") != F.col(f"old.{n}"), F.lit(False))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(differs, "changed")
    return both.select(F.col("pair").alias("snapshotNo"), "key", kind.alias("changeKind")).where("changeKind is not null")


#: Deliveries of source entries: judged by whole-millisecond mtime, state and fingerprint.
ENTRY_SNAPSHOTS = SnapshotSpec(
    snapshot="snapshotNo",
    key="sourceEntryId",
    order="lastSeenAt",
    exact={"mtime": "cast(floor(mtimeMs) as bigint)", "state": "state"},
    lenient={"fp": "lower(fingerprint)"},
)


def entry_changes(entry_snapshot: DataFrame) -> DataFrame:
    """snapshotNo, sourceEntryId, changeKind for deliveries of source entries."""
    return changes(entry_snapshot, ENTRY_SNAPSHOTS).withColumnRenamed("key", "sourceEntryId")
