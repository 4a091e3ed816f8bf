"""The hash-chained event log and snapshots as sources and sinks, and their integrity checks.

A log folder holds segments of JSON lines named by six digits; the order of records is that of
their ``seq``, not of files or lines. A record's hash is the HMAC-SHA256 of its canonical JSON
without the hash.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlake.plans.staging import delete, exists, list_names, publish_text, read_text

SEGMENTS = "[0-9]" * 6 + ".jsonl"
SCHEMA_VERSION = 1
#: Bytes after which a segment is closed.
SEGMENT_BYTES = 256 * 1024 * 1024
#: The tables of a snapshot in the order they are written.
SNAPSHOT_KINDS = ("album", "source", "sourceEntry", "duplicateLink", "media", "ingestStatus", "metadata", "quarantine")


class IntegrityError(ValueError):
    """The first record of a log that fails a check."""


def _shaped(lines: DataFrame) -> DataFrame:
    v = F.try_parse_json("value")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return lines.where(F.trim("value") != "").select(
        get("$.schemaVersion", "int").alias("schemaVersion"),
        get("$.seq", "bigint").alias("seq"),
        get("$.ts", "double").alias("ts"),
        F.struct(
            get("$.event.eventId", "string").alias("eventId"),
            get("$.event.type", "string").alias("type"),
            get("$.event.createdAt", "double").alias("createdAt"),
            get("$.event.jobId", "string").alias("jobId"),
            F.to_json(F.try_variant_get(v, "$.event.payload", "variant")).alias("payload"),
        ).alias("event"),
        get("$.prevHash", "string").alias("prevHash"),
        get("$.hash", "string").alias("hash"),
        F.col("value").alias("line"),
    )


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all segments, blank lines and other files ignored; a missing folder is empty.

    Lines that aren't JSON have null in every column but ``line`` and fail the integrity check.
    """
    if not exists(spark, folder) or not any(len(n) == 12 and n[:6].isdigit() and n.endswith(".jsonl") for n in list_names(spark, folder)):
        return _shaped(spark.createDataFrame([], "value string"))
    return _shaped(spark.read.option("pathGlobFilter", SEGMENTS).text(folder))


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """Records of segments as they are closed; the segment being written must lie elsewhere."""
    return _shaped(spark.readStream.option("pathGlobFilter", SEGMENTS).text(folder))


def last_record(log: DataFrame) -> DataFrame:
    """seq and hash of the record with the greatest seq."""
    return log.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256 of a UTF-8 text, in built-in functions only."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _number(x: float) -> str:
    """A number as the log's writer prints it: shortest digits, exponents from 1e21 and below 1e-6."""
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = f"{x!r}".partition("e")
    if not exponent and abs(x) >= 1e-6:
        return digits
    if 1e-6 <= abs(x) < 1e21:
        return f"{x:.20f}".rstrip("0") if exponent.startswith("-") and float(f"{x:.20f}") == x else digits
    if not exponent:
        digits, _, exponent = f"{x:.17e}".partition("e")
        digits = repr(float(digits))
    digits = digits.removesuffix(".0")
    return f"{digits}e{'-' if exponent[0] == '-' else '+'}{exponent.lstrip('+-').lstrip('0')}"


def canonical(value: object) -> str:
    """JSON with keys sorted at every level; keys that are array indexes come first, by number."""
    if isinstance(value, dict):
        index = lambda k: k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1
        keys = sorted((k for k in value if index(k)), key=int) + sorted((k for k in value if not index(k)), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(value)


@F.pandas_udf(T.StringType())
def _unsigned(lines: pd.Series) -> pd.Series:
    """Canonical JSON of each record without its hash; null where the line isn't a JSON object."""

    def one(line: str) -> str | None:
        try:
            record = json.loads(line)
        except (TypeError, ValueError):
            return None
        return canonical({k: v for k, v in record.items() if k != "hash"}) if isinstance(record, dict) else None

    return lines.map(one)


def sign(record: dict, secret: bytes) -> str:
    return hmac.new(secret, canonical({k: v for k, v in record.items() if k != "hash"}).encode(), hashlib.sha256).hexdigest()


def checks(log: DataFrame, secret: bytes | None = None) -> DataFrame:
    """seq, version_ok, seq_ok, prev_ok, hash_ok of each record against the one before it in seq order.

    Each record is joined with what stands at its seq and at the one before. Where several records
    have one seq, which ``seq_ok`` denies them, the next is compared with the least of their hashes.
    ``hash_ok`` is null without a secret, as the chain is then checked without recomputing hashes.
    """
    at = log.groupBy("seq").agg(F.count("*").alias("copies"), F.min("hash").alias("hash"))
    rows = log.join(at.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"), F.lit(True).alias("has")), "seq", "left")
    rows = rows.join(at.select("seq", "copies"), "seq", "left")
    hash_ok = F.lit(None).cast("boolean") if secret is None else F.coalesce(hmac_sha256(_unsigned("line"), secret) == F.col("hash"), F.lit(False))
    return rows.select(
        "seq",
        F.coalesce(F.col("schemaVersion") == SCHEMA_VERSION, F.lit(False)).alias("version_ok"),
        (((F.col("seq") == 1) | F.coalesce("has", F.lit(False))) & (F.col("copies") == 1)).alias("seq_ok"),
        F.col("prevHash").eqNullSafe(F.col("before")).alias("prev_ok"),
        hash_ok.alias("hash_ok"),
    )


def failures(log: DataFrame, secret: bytes | None = None) -> DataFrame:
    """seq and reason of the records that fail: schema_version, seq, prev_hash or hash."""
    reason = F.when(~F.col("version_ok"), "schema_version").when(~F.coalesce("seq_ok", F.lit(False)), "seq").when(~F.col("prev_ok"), "prev_hash").when(~F.col("hash_ok"), "hash")
    return checks(log, secret).select("seq", reason.alias("reason")).where("reason is not null")


def first_failure(log: DataFrame, secret: bytes | None = None) -> DataFrame:
    """seq and reason of the first record that fails; empty if none does."""
    return failures(log, secret).orderBy(F.col("seq").asc_nulls_last()).limit(1)


def verify(log: DataFrame, secret: bytes) -> DataFrame:
    """The log itself, or an ``IntegrityError`` naming its first bad record."""
    bad = first_failure(log, secret).head()
    if bad:
        raise IntegrityError(f"record {bad['seq']}: {bad['reason']}")
    return log


def append(spark: SparkSession, folder: str, events: list[dict], secret: bytes, now_ms: float, max_bytes: int = SEGMENT_BYTES) -> int:
    """Append events in order by a single writer, each in the chain; returns the last seq.

    Closed segments stay as they are; what is appended goes into new ones of at most ``max_bytes``
    (a longer record has a segment to itself).
    """
    names = [n for n in list_names(spark, folder) if len(n) == 12 and n.endswith(".jsonl") and n[:6].isdigit()]
    number = int(names[-1][:6]) if names else 0
    # Closed segments are in order, so the last one holds the last record.
    last = last_record(_shaped(spark.read.text(f"{folder}/{names[-1]}"))).head() if names else None
    seq, before = (last["seq"] or 0, last["hash"]) if last else (0, None)
    lines: list[str] = []
    size = 0

    def close() -> None:
        nonlocal number, lines, size
        if lines:
            number += 1
            publish_text(spark, f"{folder}/{number:06d}.jsonl", "".join(lines))
            lines, size = [], 0

    for event in events:
        seq += 1
        record = {"schemaVersion": SCHEMA_VERSION, "seq": seq, "ts": now_ms, "event": event}
        if before is not None:
            record["prevHash"] = before
        before = record["hash"] = sign(record, secret)
        line = json.dumps(record, ensure_ascii=False) + "\n"
        if size and size + len(line.encode()) > max_bytes:
            close()
        lines.append(line)
        size += len(line.encode())
    close()
    return seq


def write_snapshot(spark: SparkSession, folder: str, views: dict[str, DataFrame], wal_seq: int, now_ms: int, token: str) -> str:
    """Write the views as one table tagged by kind, then the pointer; returns the snapshot's name."""
    name = f"snapshot-{now_ms}-{token}"
    snapshot_union(views).write.mode("errorifexists").partitionBy("kind").parquet(f"{folder}/{name}")
    pointer = {"schemaVersion": 1, "createdAt": now_ms, "walSeq": wal_seq, "snapshotFile": name, "format": "parquet"}
    # The pointer names of equal snapshots differ, so that the newest complete one always exists.
    publish_text(spark, f"{folder}/pointer-{now_ms:020d}-{wal_seq:020d}.json", json.dumps(pointer))
    return name


def snapshot_union(views: dict[str, DataFrame]) -> DataFrame:
    """kind, record (JSON) of all rows of the views, in one table."""
    out = None
    for kind in SNAPSHOT_KINDS:
        if kind in views:
            rows = views[kind].select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("record"))
            out = rows if out is None else out.unionByName(rows)
    return out


def snapshot_pointer(spark: SparkSession, folder: str) -> dict | None:
    names = [n for n in list_names(spark, folder) if n.startswith("pointer-")]
    return json.loads(read_text(spark, f"{folder}/{names[-1]}")) if names else None


def read_snapshot(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Rows of one kind of the snapshot that the pointer names."""
    pointer = snapshot_pointer(spark, folder)
    rows = spark.read.schema("record string, kind string").parquet(f"{folder}/{pointer['snapshotFile']}").where(F.col("kind") == kind)
    return rows.select(F.from_json("record", schema).alias("r")).select("r.*")


def retained(snapshots: DataFrame, keep: str | None, most: int) -> DataFrame:
    """Snapshots (name, mtime) to keep: the newest ``most`` (none if 0 or less) and the one the pointer names."""
    newest = snapshots.orderBy(F.col("mtime").desc(), F.col("name")).limit(max(0, most))
    return newest.unionByName(snapshots.where(F.col("name") == F.lit(keep))).distinct()


def prune_snapshots(spark: SparkSession, folder: str, most: int) -> list[str]:
    """Delete snapshots that aren't retained, newest by the time in their names; returns the deleted names."""
    names = [n for n in list_names(spark, folder) if n.startswith("snapshot-")]
    pointer = snapshot_pointer(spark, folder)
    keep = {pointer["snapshotFile"]} if pointer else set()
    keep |= set(sorted(names, key=lambda n: (int(n.split("-")[1]), n), reverse=True)[: max(0, most)])
    gone = [n for n in names if n not in keep]
    for n in gone:
        delete(spark, f"{folder}/{n}")
    return gone


def listing(spark: SparkSession, root: str, recursive: bool, globs: list[str]) -> DataFrame:
    """path (relative), size, mtimeMs of the regular files under a folder; contents aren't read.

    Empty files are missing, as Spark's file source leaves them out.
    """
    from skeinlake.functions.scalars import excluded

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    relative = F.expr(f"substr(p, {len(root.rstrip('/')) + 2})")
    rows = files.withColumn("p", plain).select(relative.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtimeMs"))
    if not recursive:
        rows = rows.where(~F.col("path").contains("/"))
    return rows.where(~excluded("path", globs))


def digests(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """path, sha256, head: digests of the whole content and of the first 64 KiB of the files under a folder."""
    from skeinlake.functions.scalars import file_sha256, head_sha256

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths or root)
    return files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), file_sha256("content").alias("sha256"), head_sha256("content").alias("head"))


def rebuild_state(spark: SparkSession, log_folder: str, snapshots_folder: str | None, secret: bytes | None) -> dict[str, DataFrame]:
    """The eight current tables from the newest snapshot, if there is one, and the log's records after it.

    With a secret the whole log is verified, also what the snapshot covers.
    """
    from skeinlake.operators import views

    log = read_log(spark, log_folder)
    if secret is not None:
        log = verify(log, secret)
    pointer = snapshot_pointer(spark, snapshots_folder) if snapshots_folder else None
    events = views.typed(log)
    if pointer is None:
        return views.domain_views(events)
    records = spark.read.schema("record string, kind string").parquet(f"{snapshots_folder}/{pointer['snapshotFile']}")
    return views.rebuild(records, events.where(F.col("seq") > pointer["walSeq"]))
