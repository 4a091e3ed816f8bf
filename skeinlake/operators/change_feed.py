"""Applying a feed of inserts, updates and deletes to a bucketed table by copy-on-write.

The table lies in files by hash bucket of the key. A batch of changes is routed to
its buckets; only the files of touched buckets are read, merged with the changes in
key order and replaced by new files. Every attempt writes into a folder of its own; a
manifest names, for each bucket, the attempt whose files hold it, and publishing the
next manifest, which only one of several writers can do, is the commit. Files of
earlier attempts stay readable until ``vacuum``.

A bucket is a ledger: one row for each event of its keys, at the lowest position at
which the event was seen. Any copy may come later under a lower position and take an
event back behind others, so what an event has overtaken stays in the ledger, and
batches in any order and repetition give the same table. The current table is derived
on reading: the last upsert of a key (a deletion is an upsert that leaves a tombstone),
a later "missing" mark, and for each source its last removal. ``purge`` declares
positions settled and drops what can no longer matter, tombstones and entries of
removed sources included; the ids stay, as they recognise copies.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlake.plans.sizing import power_of_two
from skeinlake.plans.staging import Workspace, delete, list_names, nullable, publish_text, read_text

ENTRY = "sourceId string, kind string, path string, archivePath string, innerPath string, size bigint, mtimeMs double, fingerprint string, lastSeenAt double, state string"
ENTRY_FIELDS = [c.split()[0] for c in ENTRY.split(", ")]
ENTRY_STRUCT = ",".join(":".join(c.split()) for c in ENTRY.split(", "))
ENTRY_PAYLOAD = f"struct<entry:struct<sourceEntryId:string,{ENTRY_STRUCT}>,sourceEntryId:string,sourceId:string,lastSeenAt:double>"

UPSERT, MISSING, REMOVED = "SOURCE_ENTRY_UPSERTED", "SOURCE_ENTRY_MARKED_MISSING", "SOURCE_REMOVED"


def entry_events(log: DataFrame) -> DataFrame:
    """eventId, seq, type, key, removed, lastSeenAt, row of the log's events that concern entries.

    An event counts once, at its lowest seq. Rows without seq, event id or readable payload, and
    upserts or marks without an entry id and removals without a source id, change nothing.
    """
    events = log.where(F.col("event.type").isin(UPSERT, MISSING, REMOVED) & F.col("seq").isNotNull()).select(
        "seq",
        F.col("event.eventId").alias("eventId"),
        F.col("event.type").alias("type"),
        F.from_json("event.payload", ENTRY_PAYLOAD).alias("p"),
    )
    shaped = events.where("eventId is not null").select(
        "eventId",
        F.struct(
            "seq",
            "type",
            F.when(F.col("type") == UPSERT, F.col("p.entry.sourceEntryId")).when(F.col("type") == MISSING, F.col("p.sourceEntryId")).alias("key"),
            F.when(F.col("type") == REMOVED, F.col("p.sourceId")).alias("removed"),
            F.when(F.col("type") == MISSING, F.col("p.lastSeenAt")).alias("lastSeenAt"),
            F.when(F.col("type") == UPSERT, F.struct(*[f"p.entry.{f}" for f in ENTRY_FIELDS])).alias("row"),
        ).alias("e"),
    )
    first = shaped.groupBy("eventId").agg(F.min_by("e", F.col("e.seq")).alias("e")).select("eventId", "e.*")
    return first.where("(type = 'SOURCE_REMOVED' and removed is not null) or key is not null")


LEDGER = ["bucket", "key", "eventId", "seq", "upsert", "lastSeenAt", "row"]


def _ledger(events: DataFrame, buckets: int) -> DataFrame:
    """The events that concern keys, as ledger rows."""
    return events.where("key is not null").select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "eventId", "seq", (F.col("type") == UPSERT).alias("upsert"), "lastSeenAt", "row"
    )


def _merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ledger rows of both sides, each event at its lowest position; rows meet in key order inside their bucket.

    A purged event (``upsert`` null) stays purged, whatever copies of it come.
    """
    both = old.unionByName(new).repartition("bucket").sortWithinPartitions("bucket", "key", "eventId")
    first = both.groupBy("bucket", "key", "eventId").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("upsert", "lastSeenAt", "row"), "seq").alias("e"), F.bool_or(F.col("upsert").isNull()).alias("purged")
    )
    kept = lambda c: F.when(~F.col("purged"), F.col(f"e.{c}")).alias(c)
    return first.select("bucket", "key", "eventId", "seq", kept("upsert"), kept("lastSeenAt"), kept("row"))


@dataclass
class Manifest:
    version: int = 0
    buckets: int = 0
    #: bucket -> attempt that holds its rows
    files: dict[str, str] = field(default_factory=dict)
    #: attempt that holds the table of source removals
    removals: str | None = None


class EntryTable:
    """A bucketed table of source entries under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.default_buckets = spark, root, buckets

    def manifest(self) -> Manifest:
        names = [n for n in list_names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not names:
            return Manifest(buckets=self.default_buckets)
        return Manifest(**json.loads(read_text(self.spark, f"{self.root}/manifest/{names[-1]}")))

    def _schema(self) -> T.StructType:
        empty = self.spark.createDataFrame([], "seq bigint, eventId string, type string, key string, lastSeenAt double, row struct<" + ENTRY_STRUCT + ">")
        return nullable(_ledger(empty, 1).schema)

    def _rows(self, manifest: Manifest, touched: list[int] | None = None) -> DataFrame:
        schema = self._schema()
        held = {b: a for b, a in manifest.files.items() if touched is None or int(b) in touched}
        paths = [f"{self.root}/rows/attempt={a}/bucket={b}" for b, a in held.items()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/rows").parquet(*paths)
        return rows.select(*schema.names)

    def _removals(self, manifest: Manifest) -> DataFrame:
        schema = "eventId string, removed string, r bigint"
        if manifest.removals is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/removals/attempt={manifest.removals}")

    def _commit(self, manifest: Manifest, attempt: str, touched: list[int]) -> int:
        version = manifest.version + 1
        files = manifest.files | {str(b): attempt for b in touched}
        text = json.dumps({"version": version, "buckets": manifest.buckets, "files": files, "removals": attempt})
        publish_text(self.spark, f"{self.root}/manifest/{version:012d}.json", text)
        return version

    def _write(self, attempt: str, rows: DataFrame | None, removals: DataFrame) -> None:
        if rows is not None:
            rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/rows/attempt={attempt}")
        removals.coalesce(1).write.parquet(f"{self.root}/removals/attempt={attempt}")

    @staticmethod
    def _attempt(manifest: Manifest) -> str:
        """A folder name of its own, led by the version that it may become."""
        return f"{manifest.version + 1:012d}-{uuid.uuid4().hex}"

    def apply(self, events: DataFrame) -> int:
        """Merge a batch of ``entry_events`` and commit; returns the new version.

        Raises FileExistsError, leaving the table as it was and readable, if another writer commits
        the same version first; the batch can then be applied again.
        """
        manifest = self.manifest()
        new = _ledger(events, manifest.buckets)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        removed = events.where(F.col("type") == REMOVED).select("eventId", "removed", F.col("seq").alias("r"))
        removals = self._removals(manifest).unionByName(removed).groupBy("eventId").agg(F.min_by("removed", "r").alias("removed"), F.min("r").alias("r"))
        attempt = self._attempt(manifest)
        self._write(attempt, _merge(self._rows(manifest, touched), new) if touched else None, removals)
        return self._commit(manifest, attempt, touched)

    def _left(self, rows: DataFrame, manifest: Manifest) -> DataFrame:
        """key, u, row, mark of the keys that are left: not deleted, nor under a source removed after their last upsert."""
        upsert = F.col("upsert")
        last = rows.groupBy("bucket", "key").agg(
            F.max(F.when(upsert, F.col("seq"))).alias("u"), F.max_by("row", F.when(upsert, F.col("seq"))).alias("row"), F.max(F.when(~upsert, F.struct("seq", "lastSeenAt"))).alias("mark")
        )
        removals = self._removals(manifest).groupBy("removed").agg(F.max("r").alias("r"))
        there = last.where("u is not null and not (row.state <=> 'deleted')")
        return there.join(removals, (F.col("row.sourceId") == F.col("removed")) & (F.col("r") > F.col("u")), "left_anti")

    def current(self) -> DataFrame:
        """The entries that are left, a later "missing" mark laid over them."""
        manifest = self.manifest()
        left = self._left(self._rows(manifest), manifest)
        missing = F.coalesce(F.col("mark.seq") > F.col("u"), F.lit(False))
        seen = F.when(missing, F.coalesce("mark.lastSeenAt", "row.lastSeenAt")).otherwise(F.col("row.lastSeenAt"))
        return left.select(F.col("key").alias("sourceEntryId"), "row.*", missing.alias("_missing"), seen.alias("_seen")).select(
            "sourceEntryId",
            *[c for c in ENTRY_FIELDS if c not in ("lastSeenAt", "state")],
            F.col("_seen").alias("lastSeenAt"),
            F.when(F.col("_missing"), "missing").otherwise(F.col("state")).alias("state"),
        )

    def purge(self, settled: int) -> int:
        """Drop what no longer matters once no unseen event will come under a position below ``settled``; returns the new version.

        Of the events below it, each key keeps the contents of its last upsert and last mark, and
        none if it was deleted or its source removed after that; removals below it are dropped.
        Copies of known events may still come.
        """
        manifest = self.manifest()
        rows = self._rows(manifest)
        below = rows.where(F.col("seq") < settled)
        before = self._left(below, Manifest(removals=manifest.removals))
        alive = before.select("key", F.col("u").alias("_u"), F.col("mark.seq").alias("_m"))
        marked = rows.join(alive, "key", "left")
        keep = (F.col("seq") >= settled) | (F.col("seq") == F.col("_u")) | ((F.col("seq") == F.col("_m")) & (F.col("_m") > F.col("_u")))
        kept = F.coalesce(keep, F.lit(False))
        purged = marked.select("bucket", "key", "eventId", "seq", *[F.when(kept, F.col(c)).alias(c) for c in ("upsert", "lastSeenAt", "row")])
        attempt = self._attempt(manifest)
        self._write(attempt, purged.repartition("bucket").sortWithinPartitions("bucket", "key", "eventId"), self._removals(manifest).where(F.col("r") >= settled))
        return self._commit(manifest, attempt, [int(b) for b in manifest.files])

    def vacuum(self) -> None:
        """Delete the files of attempts up to the current version that the current manifest does not name.

        Attempts at the next version, which may still be committed, stay.
        """
        manifest = self.manifest()
        past = lambda name: int(name.partition("=")[2].split("-")[0]) <= manifest.version
        for name in filter(past, list_names(self.spark, f"{self.root}/rows")):
            attempt = name.partition("=")[2]
            for bucket in list_names(self.spark, f"{self.root}/rows/{name}"):
                if bucket.startswith("bucket=") and manifest.files.get(bucket.partition("=")[2]) != attempt:
                    delete(self.spark, f"{self.root}/rows/{name}/{bucket}")
            if attempt not in manifest.files.values():
                delete(self.spark, f"{self.root}/rows/{name}")
        for name in filter(past, list_names(self.spark, f"{self.root}/removals")):
            if name.partition("=")[2] != manifest.removals:
                delete(self.spark, f"{self.root}/removals/{name}")


def replay(log: DataFrame, slices: int = 2, events_per_bucket: int = 25_000) -> DataFrame:
    """The entries that result from a whole log: sourceEntryId and the entry's fields.

    The log is applied in ``slices`` of consecutive positions, each a commit on the table
    that the ones before left.
    """
    spark = log.sparkSession
    work = Workspace(spark, "replay")
    events = work.save(entry_events(log), "events")
    low, high, count = events.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    entries = EntryTable(spark, work.path("table"), buckets=power_of_two((count or 0) / events_per_bucket, 4))
    if count:
        bounds = [low + (high + 1 - low) * i // slices for i in range(slices + 1)]
        for start, end in zip(bounds, bounds[1:]):
            if start < end:
                entries.apply(events.where(F.col("seq").between(start, end - 1)))
    return entries.current()
