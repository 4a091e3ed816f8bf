"""The catalog's query endpoints as functions that return DataFrames.

A ``Catalog`` holds the current tables by name: source, sourceEntry, media, ingestStatus,
metadata, duplicateLink, quarantine, album, and jobs. Listings come in insertion order (``pos``)
where the tables have it. Filters that are None or not among the known values are ignored, as the
endpoints do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import scalars as S
from skeinlake.operators import pipeline, search, views
from skeinlake.operators.search import SearchRequest
from skeinlake.plans.staging import Workspace


def _listed(rows: DataFrame) -> DataFrame:
    return rows.orderBy("pos") if "pos" in rows.columns else rows


@dataclass
class Catalog:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    jobs: DataFrame | None = None

    @classmethod
    def of_log(cls, log: DataFrame) -> Catalog:
        work = Workspace(log.sparkSession, "catalog")
        typed = views.typed(log)
        typed.write.partitionBy("type").parquet(work.path("events"))  # parsed once; each view reads its types
        events = work.load("events", typed.schema)
        return cls(views.domain_views(events), views.jobs(events))

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        """Make the tables known to SQL as temporary views."""
        for name, rows in self.tables.items():
            rows.createOrReplaceTempView(prefix + name)

    def sources(self, roots: list[str] = ()) -> DataFrame:
        return _listed(pipeline.allowed_roots(self.tables["source"], list(roots)))

    def entries(self, source_id: str | None = None) -> DataFrame:
        rows = self.tables["sourceEntry"]
        return _listed(rows if source_id is None else rows.where(F.col("sourceId") == source_id))

    def entry(self, entry_id: str) -> DataFrame:
        t = self.tables
        one = t["sourceEntry"].where(F.col("sourceEntryId") == entry_id)
        return pipeline.entry_detail(one, t["ingestStatus"].select("sourceEntryId", "status"), t["media"], t["metadata"], t["quarantine"], t["duplicateLink"])

    def entry_by_key(self, key: str) -> DataFrame:
        columns = [F.col(c) for c in ("sourceId", "path", "archivePath", "innerPath")]
        return self.tables["sourceEntry"].where(S.natural_key(*columns) == key)

    def entries_by_head(self, head: str) -> DataFrame:
        return self.tables["sourceEntry"].where(S.head_key("fingerprint") == head)

    def media_by_hash_prefix(self, phash: str) -> DataFrame:
        """mediaId of media whose perceptual hash shares the first 4 digits of a full hash."""
        own = S.perceptual_hash(F.try_variant_get("raw", "$.perceptualHash", "string"))
        return self.tables["metadata"].where(F.substring(own, 1, 4) == F.substring(S.perceptual_hash(F.lit(phash)), 1, 4)).select("mediaId")

    def albums(self) -> DataFrame:
        return _listed(self.tables["album"])

    def media(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = _listed(self.tables["media"])
        return rows if limit is None else rows.offset(offset).limit(limit)

    def media_item(self, media_id: str) -> DataFrame:
        t = self.tables
        return pipeline.media_detail(t["media"].where(F.col("mediaId") == media_id), t["metadata"].drop("pos"), t["duplicateLink"])

    def search_view(self) -> DataFrame:
        """The view to search; store or cache it where many requests follow."""
        t = self.tables
        return search.catalog_view(t["media"], t["metadata"].withColumn("raw", F.to_json("raw")), t["sourceEntry"], t["duplicateLink"])

    def search(self, view: DataFrame, request: SearchRequest) -> DataFrame:
        """A page; raises ValueError with the endpoint's error code for requests it rejects."""
        if errors := request.errors():
            raise ValueError(errors[0])
        return search.page(view, request)

    def search_response(self, view: DataFrame, request: SearchRequest) -> dict:
        """media, total, limit, offset, sort, cursor, nextCursor and filters, as the endpoint answers."""
        if errors := request.errors():
            raise ValueError(errors[0])
        return search.respond(view, request)

    def one(self, table: str, **key: str) -> DataFrame:
        """Rows of a table by key: media by sha256 or sourceEntryId, an album, a review item, a link's existence and so on."""
        rows = self.jobs if table == "job" else self.tables[table]
        for name, value in key.items():
            rows = rows.where(F.col(name) == value)
        return rows

    def duplicate_links(self, level: str | None = None, media_id: str | None = None, entry_id: str | None = None) -> DataFrame:
        rows = self.tables["duplicateLink"]
        if level in S.LEVELS:
            rows = rows.where(F.col("level") == level)
        if media_id:
            rows = rows.where(F.col("mediaId") == media_id)
        if entry_id:
            rows = rows.where(F.col("sourceEntryId") == entry_id)
        return _listed(rows)

    def linked_entries(self, level: str | None = None) -> DataFrame:
        """Entries with a link, of a level if given."""
        return self.tables["sourceEntry"].join(self.duplicate_links(level).select("sourceEntryId"), "sourceEntryId", "left_semi")

    def quarantine(self, status: str | None = None) -> DataFrame:
        rows = self.tables["quarantine"]
        return _listed(rows.where(F.col("status") == status) if status in ("pending", "accepted", "rejected") else rows)

    def runnable_jobs(self) -> DataFrame:
        return _listed(pipeline.runnable(self.jobs))

    def metrics(self) -> DataFrame:
        t = self.tables
        return pipeline.metrics(
            {
                "sources": (t["source"], None), "entries": (t["sourceEntry"], None), "albums": (t["album"], None), "media": (t["media"], None),
                "quarantinePending": (t["quarantine"], F.col("status") == "pending"), "duplicateLinks": (t["duplicateLink"], None),
                "jobsActive": (self.jobs, F.col("status").isin("queued", "running")),
            }
        )
