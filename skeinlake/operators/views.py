"""Current tables folded from the event log, in closed form.

Each view is an aggregation that doesn't depend on the order rows arrive in: last or first event
by ``seq``, plus what happened after it. ``events`` has seq, type, createdAt and payload (a
variant); use ``typed`` on a log. Deletions and overlays are joins on the key with a comparison of
positions. ``pos`` is the position that orders listings: where a key was first inserted since it
was last removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.plans.running import running

SOURCE = "sourceId string, path string, recursive boolean, includeArchives boolean, excludeGlobs array<string>, createdAt double"
ENTRY = "sourceEntryId string, sourceId string, kind string, path string, archivePath string, innerPath string, size bigint, mtimeMs double, fingerprint string, lastSeenAt double, state string"
MEDIA = "mediaId string, sha256 string, size bigint, sourceEntryId string"
METADATA = "kind string, takenAt double, width int, height int, durationMs bigint, cameraModel string, mimeType string, raw variant"
LINK = "duplicateLinkId string, mediaId string, sourceEntryId string, level string, createdAt double, reason string"
ITEM = "quarantineId string, sourceEntryId string, candidateMediaIds array<string>, status string, createdAt double, resolvedAt double, acceptedMediaId string, rejectedReason string"
ALBUM = "albumId string, name string, mediaIds array<string>, createdAt double, updatedAt double"


def typed(log: DataFrame) -> DataFrame:
    """seq, eventId, type, createdAt, payload (variant) of log rows with a seq; each event once, at its lowest seq."""
    rows = log.where("seq is not null and event.eventId is not null")
    first = rows.groupBy("event.eventId").agg(F.min_by(F.struct("seq", "event.type", "event.createdAt", "event.payload"), "seq").alias("e"))
    return first.select("e.seq", "eventId", "e.type", "e.createdAt", F.try_parse_json("e.payload").alias("payload"))


def _struct(columns: str, root: str) -> Column:
    """A struct of typed fields below a path of the payload."""
    fields = [c.rsplit(" ", 1) if "<" not in c else c.split(" ", 1) for c in columns.split(", ")]
    return F.struct(*[F.try_variant_get("payload", f"$.{root}.{n}" if root else f"$.{n}", t).alias(n) for n, t in fields])


def _text(path: str) -> Column:
    return F.try_variant_get("payload", f"$.{path}", "string")


def _of(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def _last_wins(events: DataFrame, key: str, upserts: tuple[str, ...], removal: str, row: Column) -> DataFrame:
    """Rows of the last upsert of each key that no removal follows, with pos."""
    up = _of(events, *upserts).select("seq", row.alias("row")).withColumn("key", F.col(f"row.{key}")).where("key is not null")
    gone = _of(events, removal).select(_text(key).alias("key"), "seq").groupBy("key").agg(F.max("seq").alias("gone"))
    alive = up.join(gone, "key", "left").where("gone is null or seq > gone")
    return alive.groupBy("key").agg(F.max_by("row", "seq").alias("row"), F.min("seq").alias("pos")).select("row.*", "pos")


def sources(events: DataFrame) -> DataFrame:
    return _last_wins(events, "sourceId", ("SOURCE_CREATED", "SOURCE_UPDATED"), "SOURCE_REMOVED", _struct(SOURCE, "source"))


def albums(events: DataFrame) -> DataFrame:
    return _last_wins(events, "albumId", ("ALBUM_CREATED", "ALBUM_UPDATED"), "ALBUM_REMOVED", _struct(ALBUM, "album"))


def _upserts(events: DataFrame) -> DataFrame:
    up = _of(events, "SOURCE_ENTRY_UPSERTED").select("seq", _struct(ENTRY, "entry").alias("row"))
    return up.select("seq", F.col("row.sourceEntryId").alias("key"), F.col("row.sourceId").alias("source"), "row").where("key is not null")


def _removals(events: DataFrame) -> DataFrame:
    return _of(events, "SOURCE_REMOVED").select(_text("sourceId").alias("source"), F.col("seq").alias("r"))


def _removal_lists(removals: DataFrame) -> DataFrame:
    """source, rs: the positions at which a source was removed, one row a source, so that a join makes no row more."""
    return removals.where("source is not null").groupBy("source").agg(F.collect_set("r").alias("rs"))


def entries(events: DataFrame) -> DataFrame:
    """Entries: the last upsert, gone if its source was removed after it, with a later missing mark laid over it.

    An entry of a removed source returns with its next upsert.
    """
    up, removals = _upserts(events), _removals(events)
    last = up.groupBy("key").agg(F.max("seq").alias("u"), F.max_by(F.struct("source", "row"), "seq").alias("v")).select("key", "u", "v.source", "v.row")
    last_removal = removals.groupBy("source").agg(F.max("r").alias("r"))
    alive = last.join(last_removal, "source", "left").where("r is null or r < u").drop("r")
    # pos: the first upsert that no removal of the source held at that time follows.
    versions = up.select("key", "seq", "source", F.lead("seq").over(Window.partitionBy("key").orderBy("seq")).alias("until"))
    between = F.filter("rs", lambda r: (r > F.col("seq")) & (F.col("until").isNull() | (r < F.col("until"))))
    ends = versions.join(_removal_lists(removals), "source").groupBy("key").agg(F.max(F.array_max(between)).alias("ended"))
    since = up.join(ends, "key", "left").where("ended is null or seq > ended").groupBy("key").agg(F.min("seq").alias("pos"))
    marks = _of(events, "SOURCE_ENTRY_MARKED_MISSING").select(_text("sourceEntryId").alias("key"), F.struct("seq", F.try_variant_get("payload", "$.lastSeenAt", "double").alias("seen")).alias("m"))
    mark = marks.groupBy("key").agg(F.max("m").alias("m"))
    rows = alive.join(since, "key").join(mark, "key", "left")
    missing = F.coalesce(F.col("m.seq") > F.col("u"), F.lit(False))
    fields = [c.split()[0] for c in ENTRY.split(", ")]
    over = {"lastSeenAt": F.when(missing, F.coalesce("m.seen", "row.lastSeenAt")).otherwise(F.col("row.lastSeenAt")), "state": F.when(missing, "missing").otherwise(F.col("row.state"))}
    return rows.select(*[over.get(f, F.col(f"row.{f}")).alias(f) for f in fields], "pos")


def _imports(events: DataFrame) -> DataFrame:
    return _of(events, "MEDIA_IMPORTED").select("seq", _struct(MEDIA, "media").alias("row"))


def media(events: DataFrame, by: str = "mediaId") -> DataFrame:
    """Media by mediaId, sha256 or sourceEntryId: the last import of each, independently."""
    rows = _imports(events).withColumn("key", F.col(f"row.{by}")).where("key is not null")
    return rows.groupBy("key").agg(F.max_by("row", "seq").alias("row"), F.min("seq").alias("pos")).select("row.*", "pos")


def ingest_status(events: DataFrame, entries_: DataFrame | None = None) -> DataFrame:
    """sourceEntryId, status (none, imported, duplicate), mediaId, existingMediaId; with ``entries_``, for all of them."""
    kinds = {"MEDIA_IMPORTED": "imported", "MEDIA_SKIPPED_DUPLICATE_EXACT": "duplicate"}
    imported = F.col("type") == "MEDIA_IMPORTED"
    rows = _of(events, *kinds).select(
        "seq",
        F.when(imported, _text("media.sourceEntryId")).otherwise(_text("sourceEntryId")).alias("sourceEntryId"),
        F.struct(
            F.when(imported, "imported").otherwise("duplicate").alias("status"),
            F.when(imported, _text("media.mediaId")).alias("mediaId"),
            F.when(~imported, _text("existingMediaId")).alias("existingMediaId"),
        ).alias("s"),
    )
    last = rows.where("sourceEntryId is not null").groupBy("sourceEntryId").agg(F.max_by("s", "seq").alias("s")).select("sourceEntryId", "s.*")
    if entries_ is None:
        return last
    return entries_.select("sourceEntryId").join(last, "sourceEntryId", "left").withColumn("status", F.coalesce("status", F.lit("none")))


def metadata(events: DataFrame) -> DataFrame:
    """Metadata of each media: the last extraction."""
    rows = _of(events, "MEDIA_METADATA_EXTRACTED").select("seq", _text("mediaId").alias("mediaId"), _struct(METADATA, "metadata").alias("row"))
    return rows.where("mediaId is not null").groupBy("mediaId").agg(F.max_by("row", "seq").alias("row"), F.max("seq").alias("pos")).select("mediaId", "row.*", "pos")


def links(events: DataFrame) -> DataFrame:
    """Duplicate links: the first of each media, entry and level."""
    rows = _of(events, "DUPLICATE_LINK_CREATED").select("seq", _struct(LINK, "link").alias("row"))
    keyed = rows.groupBy("row.mediaId", "row.sourceEntryId", "row.level").agg(F.min_by("row", "seq").alias("row"), F.min("seq").alias("pos"))
    return keyed.select("row.*", "pos")


def quarantine(events: DataFrame) -> DataFrame:
    """Review items: the first of each entry, resolved by the first decision after it."""
    created = _of(events, "QUARANTINE_CREATED").select("seq", _struct(ITEM, "item").alias("row"))
    first = created.groupBy("row.sourceEntryId").agg(F.min("seq").alias("pos"), F.min_by("row", "seq").alias("row"))
    first = first.select("pos", "row", F.col("row.quarantineId").alias("id"))
    decisions = _of(events, "QUARANTINE_ACCEPTED", "QUARANTINE_REJECTED").select(
        F.col("seq").alias("at"), "type", "createdAt", _text("quarantineId").alias("id"), _text("acceptedMediaId").alias("accepted"), _text("rejectedReason").alias("reason"),
        F.try_variant_get("payload", "$.resolvedAt", "double").alias("when_"),
    )
    open_ = first.where("coalesce(row.status, 'pending') = 'pending'").select("id", "pos")
    after = decisions.join(open_, "id").where("at > pos")
    decided = after.groupBy("id").agg(F.min_by(F.struct("type", "createdAt", "accepted", "reason", "when_"), "at").alias("d"))
    rows = first.join(decided, "id", "left")
    yes = F.col("d.type") == "QUARANTINE_ACCEPTED"
    return rows.select(
        "row.quarantineId", "row.sourceEntryId", "row.candidateMediaIds",
        F.when(F.col("d").isNull(), F.coalesce("row.status", F.lit("pending"))).when(yes, "accepted").otherwise("rejected").alias("status"),
        "row.createdAt",
        F.when(F.col("d").isNull(), F.col("row.resolvedAt")).otherwise(F.coalesce("d.when_", "d.createdAt")).alias("resolvedAt"),
        F.when(F.col("d").isNull(), F.col("row.acceptedMediaId")).when(yes, F.col("d.accepted")).alias("acceptedMediaId"),
        F.when(F.col("d").isNull(), F.col("row.rejectedReason")).when(~yes, F.col("d.reason")).alias("rejectedReason"),
        "pos",
    )


JOB_STATUS = {"JOB_ENQUEUED": "queued", "JOB_STARTED": "running", "JOB_COMPLETED": "completed", "JOB_FAILED": "failed", "JOB_RETRY_SCHEDULED": "queued"}


def jobs(events: DataFrame) -> DataFrame:
    """Jobs: kind and creation from the first enqueueing, status from the last event, greatest attempt, current error.

    Events of jobs that were never enqueued are left out; see ``orphan_job_events``.
    """
    rows = _of(events, *JOB_STATUS).select(
        "seq", "type", "createdAt", _text("jobId").alias("jobId"), _text("kind").alias("kind"),
        F.try_variant_get("payload", "$.attempt", "int").alias("attempt"), _text("error").alias("error"),
        F.try_variant_get("payload", "$.retryAt", "double").alias("retryAt"),
    ).where("jobId is not null")
    status = F.lit(None).cast("string")
    for kind, name in JOB_STATUS.items():
        status = F.when(F.col("type") == kind, name).otherwise(status)
    rows = rows.withColumn("status", status)
    queued = F.col("type") == "JOB_ENQUEUED"
    clears = F.col("type").isin("JOB_STARTED", "JOB_RETRY_SCHEDULED", "JOB_FAILED")
    out = rows.groupBy("jobId").agg(
        F.min(F.when(queued, F.col("seq"))).alias("pos"),
        F.min_by(F.when(queued, F.struct("kind", "createdAt")), F.when(queued, F.col("seq"))).alias("first"),
        F.max_by("status", F.when(~queued, F.col("seq"))).alias("later"),
        F.coalesce(F.max("attempt"), F.lit(0)).alias("attempts"),
        F.max_by(F.struct(F.when(F.col("type") != "JOB_STARTED", F.col("error")).alias("error")), F.when(clears, F.col("seq"))).alias("err"),
        F.max_by(F.struct(F.coalesce(F.when(F.col("type") == "JOB_RETRY_SCHEDULED", F.col("retryAt")), F.col("createdAt")).alias("at")), F.when(~queued, F.col("seq"))).alias("upd"),
    )
    return out.where("pos is not null").select(
        "jobId", "first.kind", F.coalesce("later", F.lit("queued")).alias("status"), "attempts",
        "first.createdAt", F.coalesce("upd.at", "first.createdAt").alias("updatedAt"), F.col("err.error").alias("lastError"), "pos",
    )


def orphan_job_events(events: DataFrame) -> DataFrame:
    """jobId of job events without an enqueueing; a replay must treat them as an error."""
    ids = _of(events, *JOB_STATUS).select(_text("jobId").alias("jobId"), "type")
    return ids.join(ids.where("type = 'JOB_ENQUEUED'").select("jobId"), "jobId", "left_anti").select("jobId").distinct()


def reset_running(jobs_: DataFrame) -> DataFrame:
    """Jobs with running ones queued again, as after a restart; count them with ``jobs_.where("status = 'running'")``."""
    return jobs_.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def import_sources(events: DataFrame) -> DataFrame:
    """mediaId, sourceId as of the last import whose entry was there at that moment (the incremental index)."""
    removals = _removals(events)
    null = F.lit(None).cast("string")
    up = _upserts(events).select("key", "seq", null.alias("mediaId"), F.struct("seq", "source").alias("held"))
    imports = _imports(events).select(F.col("row.sourceEntryId").alias("key"), "seq", F.col("row.mediaId").alias("mediaId"))
    rows = up.unionByName(imports.where("key is not null and mediaId is not null"), allowMissingColumns=True)
    asof = running(rows, "key", ["seq"], "held", "max", "last").where("mediaId is not null and last is not null")
    gone = F.exists("rs", lambda r: (r > F.col("last.seq")) & (r < F.col("seq")))
    present = asof.join(_removal_lists(removals), F.col("last.source") == F.col("source"), "left").where(~F.coalesce(gone, F.lit(False)))
    return present.groupBy("mediaId").agg(F.max_by("last.source", "seq").alias("sourceId"))


def import_levels(events: DataFrame) -> DataFrame:
    """mediaId, level of the incremental index: linked media, and those imported from linked entries by then."""
    made = _of(events, "DUPLICATE_LINK_CREATED").select("seq", _text("link.mediaId").alias("mediaId"), _text("link.sourceEntryId").alias("key"), _text("link.level").alias("level"))
    imports = _imports(events).select(F.col("row.sourceEntryId").alias("key"), "seq", F.struct("seq", F.col("row.mediaId").alias("own")).alias("held"))
    rows = imports.unionByName(made.select("key", "seq", "level"), allowMissingColumns=True).where("key is not null")
    through = running(rows, "key", ["seq"], "held", "max", "last").where("held is null").select(F.col("last.own").alias("mediaId"), "level")
    return made.select("mediaId", "level").unionByName(through).where("mediaId is not null").distinct()


def domain_views(events: DataFrame) -> dict[str, DataFrame]:
    """The eight current tables by name."""
    return {
        "source": sources(events), "sourceEntry": entries(events), "media": media(events), "ingestStatus": ingest_status(events),
        "metadata": metadata(events), "duplicateLink": links(events), "quarantine": quarantine(events), "album": albums(events),
    }


#: What a row of a snapshot says again as an event: its type and the payload's field; None where the row is the payload.
_SAID_AGAIN = {
    "album": ("ALBUM_CREATED", "album"), "source": ("SOURCE_CREATED", "source"), "sourceEntry": ("SOURCE_ENTRY_UPSERTED", "entry"),
    "duplicateLink": ("DUPLICATE_LINK_CREATED", "link"), "media": ("MEDIA_IMPORTED", "media"), "quarantine": ("QUARANTINE_CREATED", "item"),
    "metadata": ("MEDIA_METADATA_EXTRACTED", "metadata"), "ingestStatus": ("MEDIA_IMPORTED", "media"),
}


def said_again(records: DataFrame, kind: str) -> DataFrame:
    """Events that a snapshot's records (kind, record) of one kind stand for, at the positions they had."""
    type_, field_ = _SAID_AGAIN[kind]
    own = records.where(F.col("kind") == kind)
    whole = F.concat(F.lit(f'{{"{field_}":'), F.col("record"), F.lit("}"))
    if kind == "metadata":
        media_id = F.expr("substr(to_json(named_struct('mediaId', get_json_object(record, '$.mediaId'))), 2)")
        whole = F.concat(F.lit('{"metadata":'), F.col("record"), F.lit(","), media_id)
    named = F.lit(type_)
    if kind == "ingestStatus":
        skipped = F.get_json_object("record", "$.status") == "duplicate"
        named = F.when(skipped, "MEDIA_SKIPPED_DUPLICATE_EXACT").otherwise(named)
        whole = F.when(skipped, F.col("record")).otherwise(whole)
    pos = F.coalesce(F.get_json_object("record", "$.pos").try_cast("bigint"), F.lit(0)).alias("seq")
    return own.select(pos, F.lit(None).cast("string").alias("eventId"), named.alias("type"), F.lit(None).cast("double").alias("createdAt"), F.try_parse_json(whole).alias("payload"))


def rebuild(records: DataFrame, tail: DataFrame) -> dict[str, DataFrame]:
    """The eight current tables from a snapshot's records (kind, record) and the events after it.

    Each table is the fold of what its records say again and the tail, so that positions,
    later changes and removals come out as from the whole log. Statuses that were never set are no rows.
    """
    fold = {"source": sources, "sourceEntry": entries, "media": media, "ingestStatus": ingest_status, "metadata": metadata, "duplicateLink": links, "quarantine": quarantine, "album": albums}
    return {kind: view(said_again(records, kind).unionByName(tail.select("seq", "eventId", "type", "createdAt", "payload"))) for kind, view in fold.items()}
