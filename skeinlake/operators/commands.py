"""The events that the catalog's jobs and write endpoints append, as rows from the state they are decided on.

Each function returns the events of many commands at once, decided on one fixed state; a command
that is refused gives a row with ``error`` and no type. Ids of new records are minted from what they
are about, so that a repeated run makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions import scalars as S
from skeinlake.operators import pipeline


def scan_events(listing: DataFrame, catalog: DataFrame, source_id: str, now_ms: float) -> DataFrame:
    """type, sourceEntryId, path, size, mtimeMs, fingerprint, lastSeenAt, state, ingest: what a scan of one source appends.

    Every listed file (path, size, mtimeMs, head: hash of its first 64 KiB) is upserted as active; its
    fingerprint is kept where size and mtime of the known entry are the same. ``ingest`` tells
    whether the file is handed on: it is new or changed. Entries of the catalog (sourceEntryId, path, size,
    mtimeMs, fingerprint, state) that weren't listed are marked missing unless they are already.
    """
    known = catalog.select("path", "sourceEntryId", F.col("size").alias("_size"), F.col("mtimeMs").alias("_mtime"), F.col("fingerprint").alias("_fp"), "state")
    both = listing.withColumn("_seen", F.lit(True)).join(known, "path", "full_outer")
    listed = F.col("_seen").isNotNull()
    same = F.col("sourceEntryId").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("mtimeMs") == F.col("_mtime"))
    same = F.coalesce(same, F.lit(False))
    entry = F.coalesce("sourceEntryId", S.minted("se", F.lit(source_id), F.col("path")))
    rows = both.where(listed | ~F.col("state").eqNullSafe("missing"))
    return rows.select(
        F.when(listed, "SOURCE_ENTRY_UPSERTED").otherwise("SOURCE_ENTRY_MARKED_MISSING").alias("type"),
        entry.alias("sourceEntryId"), "path", F.when(listed, F.col("size")).alias("size"), F.when(listed, F.col("mtimeMs")).alias("mtimeMs"),
        F.when(listed, F.when(same, F.col("_fp")).otherwise(S.fingerprint(F.col("size"), F.col("mtimeMs"), F.col("head")))).alias("fingerprint"),
        F.lit(float(now_ms)).alias("lastSeenAt"), F.when(listed, "active").otherwise("missing").alias("state"), (listed & ~same).alias("ingest"),
    )


def ingest_events(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """type, sourceEntryId, sha256, size, mediaId, level, reason: what ingesting entries appends.

    ``incoming``: entry, sha256, size, status, rank (unique); entries whose status isn't none are
    skipped. ``existing``: sha256, mediaId. Each entry's digest is reported; the first entry of
    a digest that isn't there yet is imported, others are skipped with an exact link.
    """
    rows = incoming.where(F.coalesce("status", F.lit("none")) == "none").select("entry", "sha256", "size", "rank")
    decided = pipeline.exact_dedup(rows, existing).drop("sha256").join(rows, "entry")
    of_entry = lambda e: S.minted("med", F.lit("media"), e)
    # ``original`` is a known media, or the entry that was imported first.
    first = rows.select(F.col("entry").alias("original"), F.lit(True).alias("_new"))
    decided = decided.join(first, "original", "left")
    media = F.when(F.col("imported"), of_entry(F.col("entry"))).when(F.coalesce("_new", F.lit(False)), of_entry(F.col("original"))).otherwise(F.col("original"))
    decided = decided.withColumn("_media", media)
    null = F.lit(None).cast("string")
    event = lambda kind, media, level, reason: F.struct(F.lit(kind).alias("type"), media.alias("mediaId"), level.alias("level"), reason.alias("reason"))
    computed = event("MEDIA_SHA256_COMPUTED", null, null, null)
    imported = event("MEDIA_IMPORTED", F.col("_media"), null, null)
    skipped = F.array(computed, event("MEDIA_SKIPPED_DUPLICATE_EXACT", F.col("_media"), null, null), event("DUPLICATE_LINK_CREATED", F.col("_media"), F.lit("exact"), F.lit("sha256")))
    return decided.select(F.inline(F.when(F.col("imported"), F.array(computed, imported)).otherwise(skipped)), F.col("entry").alias("sourceEntryId"), "sha256", "size").select(
        "type", "sourceEntryId", "sha256", "size", "mediaId", "level", "reason"
    )


def near_events(items: DataFrame, strong: int = 4, probable: int = 10) -> DataFrame:
    """type, sourceEntryId, mediaId, level, reason, candidateMediaIds: links and review items that near-duplicate jobs append.

    ``items`` as for ``pipeline.near_pairs``, with ``imported`` (has media), ``quarantined`` (has a review
    item) and ``linked`` (has a strong link). An entry in review or without media is left alone, and so
    is one of which another active candidate by head or hash prefix is in review; candidates
    must be imported. An entry with a strong link gets no other. All decide on the state given.
    """
    strong, probable = S.threshold(strong, 4), S.threshold(probable, 10)
    blocked = pipeline.blocked_entries(items)
    open_ = items.where(F.coalesce("imported", F.lit(False)) & ~F.coalesce("quarantined", F.lit(False))).join(blocked, "entry", "left_anti").select("entry", "linked")
    found = pipeline.classify_near(items.where("imported"), strong, probable).join(open_, "entry")
    found = found.where((F.col("outcome") == "quarantine") | ~F.coalesce("linked", F.lit(False)))
    is_strong = F.col("outcome") == "strong"
    return found.select(
        F.when(is_strong, "DUPLICATE_LINK_CREATED").otherwise("QUARANTINE_CREATED").alias("type"), F.col("entry").alias("sourceEntryId"), F.when(is_strong, F.col("mediaId")).alias("mediaId"),
        F.when(is_strong, F.lit("strong")).alias("level"), F.when(is_strong, F.format_string(f"perceptual-hamming<={strong}:%d", F.col("distance"))).alias("reason"), "candidateMediaIds",
    )


def review_events(items: DataFrame, commands: DataFrame) -> DataFrame:
    """type, quarantineId, sourceEntryId, mediaId, level, reason, at, error of accept and reject commands.

    ``items``: quarantineId, sourceEntryId, status, candidateMediaIds. ``commands``: quarantineId,
    action, mediaId, reason, at; the first of an item counts, later ones change nothing. Accepting
    appends the decision and a probable link; items that aren't pending get nothing.
    """
    first = commands.groupBy("quarantineId").agg(F.min_by(F.struct("action", "mediaId", "reason", "at"), F.struct("at", "action", "mediaId")).alias("c"))
    checked = pipeline.decide(items, commands.select("quarantineId", "action", "mediaId", "at"))
    rows = checked.join(first, "quarantineId").join(items.select("quarantineId", "sourceEntryId"), "quarantineId", "left")
    accept = F.col("c.action") == "accept"
    null = F.lit(None).cast("string")
    event = lambda kind, media, level, reason: F.struct(F.lit(kind).cast("string").alias("type"), media.alias("mediaId"), level.alias("level"), reason.alias("reason"))
    accepted = F.array(event("QUARANTINE_ACCEPTED", F.col("c.mediaId"), null, null), event("DUPLICATE_LINK_CREATED", F.col("c.mediaId"), F.lit("probable"), F.lit("quarantine-accepted")))
    rejected = F.array(event("QUARANTINE_REJECTED", null, null, F.col("c.reason")))
    refused = F.array(event(None, null, null, null))
    each = F.when(F.col("error").isNotNull(), refused).when(accept, accepted).otherwise(rejected)
    return rows.where("error is null or error <> 'not_pending'").select(F.inline(each), "quarantineId", "sourceEntryId", F.col("c.at").alias("at"), "error").select(
        "type", "quarantineId", "sourceEntryId", "mediaId", "level", "reason", "at", "error"
    )


def _members(ids: Column) -> Column:
    return S.ordered_distinct(ids)


def album_events(commands: DataFrame, albums: DataFrame, media: DataFrame) -> DataFrame:
    """type, albumId, name, mediaIds, createdAt, updatedAt, error of album commands.

    ``commands``: command (create, patch, delete), albumId (null for create), name, mediaIds (null
    where absent), at (unique). Names are trimmed; members are trimmed, blanks and repetitions left
    out; a patch keeps what it doesn't give. Errors: album_not_found, album_patch_empty,
    album_name_required, album_media_not_found.
    """
    old = albums.select(F.col("albumId"), F.col("name").alias("_name"), F.col("mediaIds").alias("_ids"), F.col("createdAt").alias("_made"), F.lit(True).alias("_known"))
    rows = commands.join(old, "albumId", "left")
    create, patch = F.col("command") == "create", F.col("command") == "patch"
    rows = rows.withColumn("_newName", F.coalesce(S.strip("name"), F.when(patch, F.col("_name")), F.lit("")))
    rows = rows.withColumn("_newIds", F.coalesce(_members(F.col("mediaIds")), F.when(patch, F.col("_ids")), F.array().cast("array<string>")))
    wanted = rows.where(F.col("command") != "delete").select("at", F.explode("_newIds").alias("mediaId"))
    unknown = wanted.join(media.select("mediaId"), "mediaId", "left_anti").select("at", F.lit(True).alias("_gap")).distinct()
    rows = rows.join(unknown, "at", "left")
    error = F.when(~create & F.col("_known").isNull(), "album_not_found")
    error = error.when(patch & F.col("name").isNull() & F.col("mediaIds").isNull(), "album_patch_empty")
    error = error.when((create | patch) & (F.col("_newName") == ""), "album_name_required").when((create | patch) & F.col("_gap"), "album_media_not_found")
    ok, kept = error.isNull(), error.isNull() & (create | patch)
    kind = F.when(create, "ALBUM_CREATED").when(patch, "ALBUM_UPDATED").otherwise("ALBUM_REMOVED")
    return rows.select(
        F.when(ok, kind).alias("type"), F.when(create, S.minted("alb", F.col("at").cast("string"))).otherwise(F.col("albumId")).alias("albumId"), F.when(kept, F.col("_newName")).alias("name"),
        F.when(kept, F.col("_newIds")).alias("mediaIds"), F.when(kept, F.when(create, F.col("at")).otherwise(F.col("_made"))).alias("createdAt"), F.when(kept, F.col("at")).alias("updatedAt"), error.alias("error"),
    )


def source_events(commands: DataFrame, sources: DataFrame, roots: list[str] = ()) -> DataFrame:
    """type, sourceId, path, recursive, includeArchives, excludeGlobs, createdAt, error of source commands.

    ``commands``: command (create, patch, delete), sourceId (null for create), path, recursive,
    includeArchives, excludeGlobs (null where absent), at (unique). A new source is recursive, without
    archives and exclusions, unless told otherwise; a patch keeps what it doesn't give; a removal
    doesn't ask whether the source exists. Errors: path_required, source_not_found,
    source_path_not_allowed.
    """
    fields = ["path", "recursive", "includeArchives", "excludeGlobs"]
    old = sources.select("sourceId", *[F.col(f).alias(f"_{f}") for f in fields], F.col("createdAt").alias("_made"), F.lit(True).alias("_known"))
    rows = commands.join(old, "sourceId", "left")
    create, patch = F.col("command") == "create", F.col("command") == "patch"
    default = {"path": F.lit(""), "recursive": F.lit(True), "includeArchives": F.lit(False), "excludeGlobs": F.array().cast("array<string>")}
    rows = rows.withColumns({f"_new_{f}": F.coalesce(F.col(f), F.when(patch, F.col(f"_{f}")).otherwise(default[f])) for f in fields})
    allowed = F.lit(not roots)
    for root in roots:
        plain = root.rstrip("/")
        allowed |= (F.col("_new_path") == plain) | F.col("_new_path").startswith(plain + "/")
    error = F.when(create & (F.col("_new_path") == ""), "path_required").when(patch & F.col("_known").isNull(), "source_not_found").when((create | patch) & ~allowed, "source_path_not_allowed")
    ok, kept = error.isNull(), error.isNull() & (create | patch)
    kind = F.when(create, "SOURCE_CREATED").when(patch, "SOURCE_UPDATED").otherwise("SOURCE_REMOVED")
    return rows.select(
        F.when(ok, kind).alias("type"), F.when(create, S.minted("src", F.col("at").cast("string"))).otherwise(F.col("sourceId")).alias("sourceId"),
        *[F.when(kept, F.col(f"_new_{f}")).alias(f) for f in fields], F.when(kept, F.when(create, F.col("at")).otherwise(F.col("_made"))).alias("createdAt"), error.alias("error"),
    )
