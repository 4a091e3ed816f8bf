"""Views kept up to date from a stream of log records.

Source entries are merged into the bucketed entry table by copy-on-write. The other views come from
an ``EventStore``: each micro-batch becomes one part of it, written once whatever is repeated after a
failure, and the views are folds over the parts on reading. Events merge in any order and any number
of times, so that late records, copies under other positions, and batches delivered again
give the same tables as timely ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinlake.operators import views
from skeinlake.operators.change_feed import EntryTable, entry_events
from skeinlake.plans.staging import delete, exists, list_names, publish_text, read_text
from skeinlake.sources import log as wal

EVENTS = "seq bigint, eventId string, type string, createdAt double, payload variant"


def maintain_entries(log: DataFrame, entries: EntryTable, checkpoint: str) -> StreamingQuery:
    """Start a query that applies all records available to the table and stops."""

    def apply(batch: DataFrame, _: int) -> None:
        entries.apply(entry_events(batch))

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class EventStore:
    """The events of a log under ``root``, in parts of one micro-batch each, partitioned by type."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, part: int, log: DataFrame) -> None:
        """Write a part, in place of what an attempt that failed may have left of it."""
        views.typed(log).write.mode("overwrite").partitionBy("type").parquet(f"{self.root}/events/part={part}")

    def events(self) -> DataFrame:
        """All events, each once, at its lowest position."""
        if not any(n.startswith("part=") for n in list_names(self.spark, f"{self.root}/events")):
            return self.spark.createDataFrame([], EVENTS)
        rows = self.spark.read.schema(EVENTS).parquet(f"{self.root}/events")
        first = rows.groupBy("eventId").agg(F.min_by(F.struct("seq", "type", "createdAt", "payload"), "seq").alias("e"))
        return first.select("e.seq", "eventId", "e.type", "e.createdAt", "e.payload")

    def views(self) -> dict[str, DataFrame]:
        """The eight current tables and the jobs."""
        events = self.events()
        return views.domain_views(events) | {"job": views.jobs(events)}

    def compact(self, into: int) -> None:
        """Put the parts up to ``into`` into it as one; call it while no query writes them."""
        events = self.events()
        events.write.partitionBy("type").parquet(f"{self.root}/compacted")
        parts = [n for n in list_names(self.spark, f"{self.root}/events") if n.startswith("part=") and int(n[5:]) <= into]
        rows = self.spark.read.schema(EVENTS).parquet(f"{self.root}/compacted")
        rows.write.mode("overwrite").partitionBy("type").parquet(f"{self.root}/events/part={into}")
        for name in parts:
            if name != f"part={into}":
                delete(self.spark, f"{self.root}/events/{name}")
        delete(self.spark, f"{self.root}/compacted")

    def _carried(self, before: int) -> dict | None:
        names = [n for n in list_names(self.spark, f"{self.root}/chain") if n.endswith(".json") and int(n[:-5]) < before]
        return json.loads(read_text(self.spark, f"{self.root}/chain/{names[-1]}")) if names else None

    def check(self, part: int, log: DataFrame, secret: bytes | None) -> None:
        """Verify a part's records against each other and the last record of the parts before; raises ``IntegrityError``."""
        carried = self._carried(part)
        rows = log
        if carried:
            last = self.spark.createDataFrame([(wal.SCHEMA_VERSION, carried["seq"], carried["hash"])], "schemaVersion int, seq bigint, hash string")
            rows = log.unionByName(last, allowMissingColumns=True)
        failures = wal.failures(rows, secret)
        if carried:
            failures = failures.where(F.col("seq").isNull() | (F.col("seq") != carried["seq"]))
        bad = failures.orderBy(F.col("seq").asc_nulls_last()).head()
        if bad:
            raise wal.IntegrityError(f"record {bad['seq']}: {bad['reason']}")
        last = wal.last_record(log).head()
        path = f"{self.root}/chain/{part:012d}.json"
        if last["seq"] is not None and not exists(self.spark, path):
            publish_text(self.spark, path, json.dumps({"seq": last["seq"], "hash": last["hash"]}))


def maintain_events(log: DataFrame, store: EventStore, checkpoint: str, verify: bool = False, secret: bytes | None = None) -> StreamingQuery:
    """Start a query that puts all records available into the store and stops.

    With ``verify`` the records must come in order, as those of closed segments do, and the query fails at
    the first that breaks the chain, which is carried from batch to batch.
    """

    def put(batch: DataFrame, part: int) -> None:
        held = batch.persist()
        if verify:
            store.check(part, held, secret)
        store.put(part, held)
        held.unpersist()

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
