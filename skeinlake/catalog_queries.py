"""Queries over the catalog operators with their SQL equivalents.

The search queries run on orders as a catalog (``orders_catalog``), the views on wal_record, the
rest on the catalog tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import scalars as S
from skeinlake.operators import commands, extraction, pipeline, search, views
from skeinlake.operators.search import SearchRequest
from skeinlake.plans.api import Catalog
from skeinlake.plans.staging import Workspace
from skeinlake.sources import log
from skeinlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query, and its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Search


def orders_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a catalog view: status as kind, priority as type and camera, date as capture time."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    lat, lon = F.col("o_totalprice") / 10000.0, (F.col("o_custkey") % 360 - 180).cast("double") + 0.25
    taken = F.when(key % 17 != 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double"))
    return o.select(
        F.concat(F.lit("med_"), F.lpad(key.cast("string"), 10, "0")).alias("mediaId"),
        (key % 101 != 0).alias("present"),
        F.col("o_orderstatus").alias("kind"),
        S.normalized("o_orderpriority").alias("mimeType"),
        F.concat(F.lit("src_"), (F.col("o_custkey") % 7).cast("string")).alias("sourceId"),
        F.when(key % 3 == 0, F.array(F.lit("exact"), F.lit("strong"))).when(key % 3 == 1, F.array(F.lit("probable"))).alias("levels"),
        F.concat(F.lit("camera "), (F.col("o_custkey") % 3).cast("string")).alias("cameraModel"),
        taken.alias("takenAt"),
        S.taken_day(taken).alias("takenDay"),
        S.gps_tile(lat, lon).alias("gpsTile"),
        F.sha2(key.cast("string"), 256).alias("sha256"),
    )


CATALOG_SQL = """
    WITH catalog AS (
        SELECT 'med_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS "mediaId", o_orderkey % 101 <> 0 AS present,
               o_orderstatus AS kind, lower(trim(o_orderpriority)) AS "mimeType",
               'src_' || CAST(o_custkey % 7 AS VARCHAR) AS "sourceId",
               CASE o_orderkey % 3 WHEN 0 THEN ['exact', 'strong'] WHEN 1 THEN ['probable'] END AS levels,
               'camera ' || CAST(o_custkey % 3 AS VARCHAR) AS "cameraModel",
               CASE WHEN o_orderkey % 17 <> 0 THEN CAST(epoch_ms(o_orderdate) AS DOUBLE) END AS "takenAt",
               CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "takenDay",
               printf('%.1f', floor(o_totalprice / 10000.0 * 10) / 10) || ':' ||
               printf('%.1f', floor((CAST(o_custkey % 360 - 180 AS DOUBLE) + 0.25) * 10) / 10) AS "gpsTile",
               sha256(CAST(o_orderkey AS VARCHAR)) AS sha256
        FROM orders)
"""
PAGE = ["mediaId", "kind", "cameraModel", "takenAt", "takenDay", "gpsTile"]
_PAGE_SQL = 'SELECT "mediaId", kind, "cameraModel", "takenAt", "takenDay", "gpsTile" FROM '
_ASC, _DESC = 'ORDER BY "mediaId"', 'ORDER BY "takenAt" DESC NULLS LAST, "mediaId"'


def _searched(name: str, request: SearchRequest, where: str, order: str = _ASC, limit: int = 100, offset: int = 0) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return search.page(orders_catalog(spark, folder), request).select(*PAGE)

    QUERIES[name] = run
    ORACLES[name] = f"{CATALOG_SQL} {_PAGE_SQL} (SELECT * FROM catalog WHERE {where} {order} LIMIT {limit} OFFSET {offset}) WHERE present"


_searched("search_kind_asc", SearchRequest(kind="F"), "kind = 'F'")
_searched("search_camera_taken_desc", SearchRequest(camera_model=" Camera 1 ", sort="takenAt_desc"), "\"cameraModel\" = 'camera 1'", _DESC)
_searched("search_taken_day", SearchRequest(taken_day="1995-03-15", limit=500), "\"takenDay\" = '1995-03-15'", limit=500)
_searched("search_mime_type", SearchRequest(mime_type="1-URGENT"), "\"mimeType\" = '1-urgent'")
_searched("search_source", SearchRequest(source_id="src_3", sort="takenAt_desc", limit=50), "\"sourceId\" = 'src_3'", _DESC, 50)
_searched("search_dup_level", SearchRequest(duplicate_level="strong"), "list_contains(levels, 'strong')")
for _n, _prefix in {2: "a1", 3: "A1B", 4: "a1b2"}.items():
    _searched(f"search_sha_prefix_{_n}", SearchRequest(sha256_prefix=_prefix, limit=500), f"starts_with(sha256, '{_prefix.lower()}')", limit=500)


def _searched_by_first(name: str, column: str, make: Callable[[str], SearchRequest], where: str) -> None:
    """A search for what the first order of the catalog has in a column, so that it finds something in any folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        catalog = orders_catalog(spark, folder)
        value = catalog.where("present").agg(F.min_by(column, "mediaId")).head()[0]
        return search.page(catalog, make(value)).select(*PAGE)

    QUERIES[name] = run
    first = f"(SELECT arg_min(\"{column}\", \"mediaId\") FROM catalog WHERE present)"
    ORACLES[name] = f"{CATALOG_SQL} {_PAGE_SQL} (SELECT * FROM catalog WHERE {where.format(first)} {_ASC} LIMIT 500) WHERE present"


_searched_by_first("search_gps_tile", "gpsTile", lambda v: SearchRequest(gps_tile=v, limit=500), '"gpsTile" = {}')
for _n in (5, 8, 9):
    _searched_by_first(f"search_sha_prefix_{_n}", "sha256", lambda v, n=_n: SearchRequest(sha256_prefix=v[:n].upper(), limit=500), f"starts_with(sha256, left({{}}, {_n}))")
_searched("search_sha_prefix_64", SearchRequest(sha256_prefix="6B86B273FF34FCE19D6B804EFF5A3F5747ADA4EAA22F1D49C01E52DDB7875B4B"), "sha256 = sha256('1')")
_searched("search_invalid_prefix_empty", SearchRequest(sha256_prefix="zzz"), "false")
_searched("search_conjunctive", SearchRequest(kind="O", camera_model="camera 2", source_id="src_1", duplicate_level="probable", sort="takenAt_desc"), "kind = 'O' AND \"cameraModel\" = 'camera 2' AND \"sourceId\" = 'src_1' AND list_contains(levels, 'probable')", _DESC)
_searched("page_offset", SearchRequest(kind="P", limit=40, offset=20), "kind = 'P'", limit=40, offset=20)
_searched("page_keyset_asc", SearchRequest(kind="F", limit=25, cursor="med_0000000500x"), "kind = 'F' AND \"mediaId\" > 'med_0000000500x'", limit=25)
_CURSOR = "(SELECT \"takenAt\" FROM catalog WHERE \"mediaId\" = 'med_0000000100')"
_searched("page_keyset_desc", SearchRequest(kind="F", sort="takenAt_desc", limit=25, cursor="med_0000000100"), f"kind = 'F' AND (\"takenAt\" < {_CURSOR} OR \"takenAt\" IS NULL OR (\"takenAt\" = {_CURSOR} AND \"mediaId\" > 'med_0000000100'))", _DESC, 25)
_searched("page_unknown_cursor_desc", SearchRequest(kind="F", sort="takenAt_desc", limit=25, cursor="med_none"), "kind = 'F'", _DESC, 25)
_searched("search_all_media", SearchRequest(limit=500), "present", limit=500)


@query(CATALOG_SQL + "SELECT count(*) AS total FROM catalog WHERE kind = 'F' AND \"cameraModel\" = 'camera 0'")
def search_total(spark, folder):
    return search.total(orders_catalog(spark, folder), SearchRequest(kind="F", camera_model="camera 0"))


@query(CATALOG_SQL + "SELECT value, count(*) AS n FROM (SELECT unnest(levels) AS value FROM catalog) GROUP BY 1")
def facet_levels(spark, folder):
    return search.facet_counts(orders_catalog(spark, folder), "levels")


@query(CATALOG_SQL + 'SELECT "gpsTile" AS value, count(*) AS n FROM catalog GROUP BY 1')
def facet_gps_tiles(spark, folder):
    return search.facet_counts(orders_catalog(spark, folder), "gpsTile")


@query("""
    SELECT total, "limit", "offset", greatest(1, CAST(ceil(total / CAST("limit" AS DOUBLE)) AS BIGINT)) AS "pageCount",
           least(CAST(floor("offset" / CAST("limit" AS DOUBLE)) AS BIGINT) + 1, greatest(1, CAST(ceil(total / CAST("limit" AS DOUBLE)) AS BIGINT))) AS "pageNumber",
           "offset" > 0 AS "hasPrev", "offset" + "limit" < total AS "hasNext"
    FROM (SELECT o_custkey % 50 AS total, 1 + o_orderkey % 9 AS "limit", o_orderkey % 60 AS "offset" FROM orders)
""")
def page_stats(spark, folder):
    rows = table(spark, folder, "orders").selectExpr("o_custkey % 50 as total", "1 + o_orderkey % 9 as limit", "o_orderkey % 60 as offset")
    return search.page_stats(rows)


@query(CATALOG_SQL + """SELECT "mediaId" FROM catalog c WHERE present AND kind <> 'O' AND (contains("mediaId", 'a7') OR contains(sha256, 'a7')) ORDER BY 1 LIMIT 30""")
def picker_filter(spark, folder):
    catalog = orders_catalog(spark, folder)
    return search.pick(catalog, catalog.where("kind = 'O'"), " A7 ", 30).select("mediaId")


CURRENT_SQL = "current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mediaId ORDER BY extractedAt DESC) AS rn FROM media_metadata) WHERE rn = 1)"
MEDIA_SQL = "m AS (SELECT DISTINCT mediaId, sha256, size, sourceEntryId FROM media)"
LINKS_SQL = "links AS (SELECT DISTINCT mediaId, sourceEntryId, lower(trim(level)) AS level FROM duplicate_link WHERE mediaId IS NOT NULL AND sourceEntryId IS NOT NULL AND lower(trim(level)) IN ('exact', 'strong', 'probable'))"


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The current metadata of each media, takenAt left as delivered."""
    m = table(spark, folder, "media_metadata")
    return m.groupBy("mediaId").agg(F.max(F.struct("extractedAt", *[c for c in m.columns if c not in ("mediaId", "extractedAt")])).alias("r")).select("mediaId", "r.*")


def media_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "media").select("mediaId", "sha256", "size", "sourceEntryId").distinct()


def link_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "duplicate_link").select("mediaId", "sourceEntryId", S.duplicate_level("level").alias("level"))
    return rows.where("mediaId is not null and sourceEntryId is not null and level is not null").distinct()


def latest_entries(spark: SparkSession, folder: str, *more: str, back: int = 0) -> DataFrame:
    """Entries of the newest delivery or one before it, with further columns if named: the row seen last, the greatest path among equals."""
    rows = table(spark, folder, "entry_snapshot")
    numbers = rows.select("snapshotNo").where("snapshotNo is not null").distinct().orderBy(F.col("snapshotNo").desc())
    wanted = numbers.offset(back).limit(1).withColumnRenamed("snapshotNo", "newest")
    e = rows.join(F.broadcast(wanted), F.col("snapshotNo") == F.col("newest")).where("sourceEntryId is not null")  # one row
    fields = ["sourceId", "path", "size", "mtimeMs", "state", "fingerprint", *more]
    return e.groupBy("sourceEntryId").agg(F.max(F.struct("lastSeenAt", *fields)).alias("r")).select("sourceEntryId", "r.*")


def _newest(back: int) -> str:
    return f"(SELECT DISTINCT snapshotNo FROM entry_snapshot WHERE snapshotNo IS NOT NULL ORDER BY 1 DESC LIMIT 1 OFFSET {back})"


def _entries_sql(name: str, back: int = 0) -> str:
    return f"""{name} AS (SELECT sourceEntryId, r.sourceId AS sourceId, r.path AS path, r.size AS size, r.mtimeMs AS mtimeMs, r.state AS state, r.fingerprint AS fingerprint
        FROM (SELECT sourceEntryId, max(struct_pack(seen := lastSeenAt, sourceId := sourceId, path := path, size := size, mtimeMs := mtimeMs, state := state, fingerprint := fingerprint)) AS r
              FROM entry_snapshot WHERE snapshotNo = {_newest(back)} AND sourceEntryId IS NOT NULL GROUP BY 1))"""


@query(f"""
    WITH {CURRENT_SQL}, {MEDIA_SQL}, {LINKS_SQL}, {_entries_sql('e')},
    levels AS (SELECT mediaId, level FROM links UNION SELECT m.mediaId, level FROM links JOIN m USING (sourceEntryId))
    SELECT mediaId AS "mediaId", m.mediaId IS NOT NULL AS present, c.kind, nullif(lower(trim(c.cameraModel)), '') AS "cameraModel", e.sourceId AS "sourceId", l.levels
    FROM m FULL JOIN current c USING (mediaId)
         FULL JOIN (SELECT mediaId, string_agg(level, ',' ORDER BY level) AS levels FROM levels GROUP BY 1) l USING (mediaId)
         LEFT JOIN e ON e.sourceEntryId = m.sourceEntryId
    WHERE c.kind = 'photo' AND contains(l.levels, 'strong')
""")
def search_media_tables(spark, folder):
    """Photos with a strong link, over the catalog tables."""
    metadata = current(spark, folder).withColumn("takenAt", F.unix_millis(F.col("extractedAt").cast("timestamp")).cast("double"))
    view = search.catalog_view(media_rows(spark, folder), metadata, latest_entries(spark, folder), link_rows(spark, folder))
    rows = search.matching(view, SearchRequest(kind="photo", duplicate_level="strong"))
    return rows.select("mediaId", "present", "kind", "cameraModel", "sourceId", F.array_join("levels", ",").alias("levels"))


# Views of the log

EVENTS_SQL = "ev AS (SELECT min(seq) AS seq, arg_min(event.type, seq) AS type, arg_min(event.createdAt, seq) AS made, arg_min(event.payload, seq) AS p FROM wal_record GROUP BY event.eventId)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return views.typed(table(spark, folder, "wal_record"))


@query(f"""
    WITH {EVENTS_SQL},
    gone AS (SELECT p->>'$.sourceId' AS id, max(seq) AS r FROM ev WHERE type = 'SOURCE_REMOVED' GROUP BY 1),
    up AS (SELECT p->>'$.source.sourceId' AS id, seq, p FROM ev WHERE type IN ('SOURCE_CREATED', 'SOURCE_UPDATED'))
    SELECT up.id AS "sourceId", arg_max(p->>'$.source.path', seq) AS path, min(seq) AS pos
    FROM up LEFT JOIN gone USING (id) WHERE r IS NULL OR seq > r GROUP BY 1
""")
def view_sources(spark, folder):
    return views.sources(events(spark, folder)).select("sourceId", "path", "pos")


@query(f"""
    WITH {EVENTS_SQL},
    up AS (SELECT p->>'$.entry.sourceEntryId' AS id, p->>'$.entry.sourceId' AS source, seq, p, lead(seq) OVER (PARTITION BY p->>'$.entry.sourceEntryId' ORDER BY seq) AS until
           FROM ev WHERE type = 'SOURCE_ENTRY_UPSERTED'),
    gone AS (SELECT p->>'$.sourceId' AS source, seq AS r FROM ev WHERE type = 'SOURCE_REMOVED'),
    ended AS (SELECT id, max(r) AS r FROM up JOIN gone USING (source) WHERE r > seq AND (until IS NULL OR r < until) GROUP BY 1),
    alive AS (SELECT up.* FROM up LEFT JOIN ended USING (id) WHERE r IS NULL OR seq > r),
    last AS (SELECT id, max(seq) AS u, min(seq) AS pos, arg_max(p, seq) AS p FROM alive GROUP BY 1),
    mark AS (SELECT p->>'$.sourceEntryId' AS id, max(seq) AS m FROM ev WHERE type = 'SOURCE_ENTRY_MARKED_MISSING' GROUP BY 1)
    SELECT id AS "sourceEntryId", p->>'$.entry.sourceId' AS "sourceId", p->>'$.entry.path' AS path,
           CASE WHEN m > u THEN 'missing' ELSE p->>'$.entry.state' END AS state, pos
    FROM last LEFT JOIN mark USING (id)
""")
def view_entries(spark, folder):
    return views.entries(events(spark, folder)).select("sourceEntryId", "sourceId", "path", "state", "pos")


@query(f"""
    WITH {EVENTS_SQL}
    SELECT p->>'$.media.sourceEntryId' AS "sourceEntryId", arg_max(p->>'$.media.mediaId', seq) AS "mediaId", arg_max(p->>'$.media.sha256', seq) AS sha256, min(seq) AS pos
    FROM ev WHERE type = 'MEDIA_IMPORTED' GROUP BY 1
""")
def view_media_by_entry(spark, folder):
    return views.media(events(spark, folder), "sourceEntryId").select("sourceEntryId", "mediaId", "sha256", "pos")


@query(f"""
    WITH {EVENTS_SQL}
    SELECT CASE type WHEN 'MEDIA_IMPORTED' THEN p->>'$.media.sourceEntryId' ELSE p->>'$.sourceEntryId' END AS "sourceEntryId",
           arg_max(CASE type WHEN 'MEDIA_IMPORTED' THEN 'imported' ELSE 'duplicate' END, seq) AS status
    FROM ev WHERE type IN ('MEDIA_IMPORTED', 'MEDIA_SKIPPED_DUPLICATE_EXACT') GROUP BY 1
""")
def view_ingest_status(spark, folder):
    return views.ingest_status(events(spark, folder)).select("sourceEntryId", "status")


@query(f"""
    WITH {EVENTS_SQL}, j AS (SELECT p->>'$.jobId' AS id, seq, type, made, p FROM ev WHERE type LIKE 'JOB_%')
    SELECT id AS "jobId", arg_min(p->>'$.kind', seq) FILTER (type = 'JOB_ENQUEUED') AS kind,
           coalesce(arg_max(CASE type WHEN 'JOB_STARTED' THEN 'running' WHEN 'JOB_FAILED' THEN 'failed' WHEN 'JOB_COMPLETED' THEN 'completed' ELSE 'queued' END, seq) FILTER (type <> 'JOB_ENQUEUED'), 'queued') AS status,
           CAST(coalesce(max(CAST(p->>'$.attempt' AS INTEGER)), 0) AS INTEGER) AS attempts, min(seq) FILTER (type = 'JOB_ENQUEUED') AS pos
    FROM j GROUP BY 1 HAVING min(seq) FILTER (type = 'JOB_ENQUEUED') IS NOT NULL
""")
def view_jobs(spark, folder):
    return views.jobs(events(spark, folder)).select("jobId", "kind", "status", "attempts", "pos")


@query(f"""
    WITH {EVENTS_SQL}, j AS (SELECT p->>'$.jobId' AS id, type FROM ev WHERE type LIKE 'JOB_%')
    SELECT DISTINCT id AS "jobId" FROM j WHERE id NOT IN (SELECT id FROM j WHERE type = 'JOB_ENQUEUED' AND id IS NOT NULL)
""")
def orphan_jobs(spark, folder):
    return views.orphan_job_events(events(spark, folder))


@query(f"""
    WITH {EVENTS_SQL},
    up AS (SELECT p->>'$.entry.sourceEntryId' AS id, p->>'$.entry.sourceId' AS source, seq FROM ev WHERE type = 'SOURCE_ENTRY_UPSERTED'),
    gone AS (SELECT p->>'$.sourceId' AS source, seq AS r FROM ev WHERE type = 'SOURCE_REMOVED'),
    im AS (SELECT p->>'$.media.mediaId' AS media, p->>'$.media.sourceEntryId' AS id, seq AS t FROM ev WHERE type = 'MEDIA_IMPORTED'),
    held AS (SELECT media, t, max(seq) AS seq, arg_max(source, seq) AS source FROM im JOIN up USING (id) WHERE seq < t GROUP BY 1, 2),
    ok AS (SELECT * FROM held WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.source = held.source AND r > seq AND r < t))
    SELECT media AS "mediaId", arg_max(source, t) AS "sourceId" FROM ok GROUP BY 1
""")
def view_index_asof(spark, folder):
    return views.import_sources(events(spark, folder))


def made_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the kinds that wal_record lacks, from the tables of their results: metadata, links, review items and their decisions, albums of candidates."""
    text = lambda *fields: F.try_parse_json(F.to_json(F.struct(*fields)))

    def event(rows: DataFrame, kind: str, seq: str, *payload) -> DataFrame:
        return rows.select(F.col(seq).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("eventId"), F.lit(kind).alias("type"), F.col(seq).cast("double").alias("createdAt"), text(*payload).alias("payload"))

    m = table(spark, folder, "media_metadata").where("mediaId is not null").withColumn("at", F.unix_micros(F.col("extractedAt").cast("timestamp")))
    d, q = table(spark, folder, "duplicate_link"), table(spark, folder, "quarantine_item")
    metadata = F.struct("kind", "width", "height", "durationMs", "cameraModel", "mimeType").alias("metadata")
    out = event(m, "MEDIA_METADATA_EXTRACTED", "at", "mediaId", metadata)
    out = out.unionByName(event(d, "DUPLICATE_LINK_CREATED", "createdAt", F.struct("duplicateLinkId", "mediaId", "sourceEntryId", F.lower(F.trim("level")).alias("level"), "createdAt").alias("link")))
    pending, decided = q.where("status = 'pending'"), q.where("status <> 'pending'")
    out = out.unionByName(event(pending, "QUARANTINE_CREATED", "createdAt", F.struct("quarantineId", "sourceEntryId", "candidateMediaIds", "status", "createdAt").alias("item")))
    out = out.unionByName(event(decided.where("status = 'accepted'"), "QUARANTINE_ACCEPTED", "resolvedAt", "quarantineId", "acceptedMediaId", "resolvedAt"))
    out = out.unionByName(event(decided.where("status = 'rejected'"), "QUARANTINE_REJECTED", "resolvedAt", "quarantineId", "rejectedReason", "resolvedAt"))
    album = F.struct(F.col("quarantineId").alias("albumId"), F.concat(F.lit("of "), "sourceEntryId").alias("name"), F.col("candidateMediaIds").alias("mediaIds"), "createdAt").alias("album")
    out = out.unionByName(event(pending, "ALBUM_CREATED", "createdAt", album))
    return out.unionByName(event(decided.where("status = 'rejected'"), "ALBUM_REMOVED", "resolvedAt", F.col("quarantineId").alias("albumId")))


_DECIDED_SQL = """
    made AS (SELECT quarantineId AS id, sourceEntryId AS entry, CAST(floor(createdAt) AS BIGINT) AS pos FROM quarantine_item WHERE status = 'pending'),
    first AS (SELECT entry, min(pos) AS pos, arg_min(id, struct_pack(pos := pos, id := id)) AS id FROM made GROUP BY 1),
    d AS (SELECT quarantineId AS id, CAST(floor(resolvedAt) AS BIGINT) AS at, min(struct_pack(status := status, media := acceptedMediaId, resolved := resolvedAt)) AS r FROM quarantine_item WHERE status <> 'pending' GROUP BY 1, 2),
    won AS (SELECT f.id, arg_min(d.r, d.at) AS r FROM first f JOIN d USING (id) WHERE d.at > f.pos GROUP BY 1)
"""


@query("""
    SELECT mediaId AS "mediaId", arg_max(struct_pack(k := kind), extractedAt).k AS kind, arg_max(struct_pack(k := width), extractedAt).k AS width,
           arg_max(struct_pack(k := mimeType), extractedAt).k AS "mimeType", CAST(epoch_us(max(extractedAt)) AS BIGINT) AS pos FROM media_metadata WHERE mediaId IS NOT NULL GROUP BY 1
""")
def view_metadata(spark, folder):
    return views.metadata(made_events(spark, folder)).select("mediaId", "kind", "width", "mimeType", "pos")


@query("""
    SELECT mediaId AS "mediaId", sourceEntryId AS "sourceEntryId", lower(trim(level)) AS level, min(CAST(floor(createdAt) AS BIGINT)) AS pos FROM duplicate_link GROUP BY 1, 2, 3
""")
def view_links(spark, folder):
    return views.links(made_events(spark, folder)).select("mediaId", "sourceEntryId", "level", "pos")


@query(f"""
    WITH {_DECIDED_SQL}
    SELECT first.id AS "quarantineId", entry AS "sourceEntryId", coalesce(r.status, 'pending') AS status, r.resolved AS "resolvedAt", CASE WHEN r.status = 'accepted' THEN r.media END AS "acceptedMediaId", pos
    FROM first LEFT JOIN won USING (id)
""")
def view_quarantine(spark, folder):
    return views.quarantine(made_events(spark, folder)).select("quarantineId", "sourceEntryId", "status", "resolvedAt", "acceptedMediaId", "pos")


@query("""
    WITH up AS (SELECT quarantineId AS id, CAST(floor(createdAt) AS BIGINT) AS seq, 'of ' || sourceEntryId AS name FROM quarantine_item WHERE status = 'pending'),
    gone AS (SELECT quarantineId AS id, max(CAST(floor(resolvedAt) AS BIGINT)) AS gone FROM quarantine_item WHERE status = 'rejected' GROUP BY 1)
    SELECT id AS "albumId", arg_max(name, seq) AS name, min(seq) AS pos FROM up LEFT JOIN gone USING (id) WHERE gone IS NULL OR seq > gone GROUP BY 1
""")
def view_albums(spark, folder):
    return views.albums(made_events(spark, folder)).select("albumId", "name", "pos")


@query(f"""
    WITH {EVENTS_SQL}
    SELECT p->>'$.media.mediaId' AS "mediaId", arg_max(p->>'$.media.sha256', seq) AS sha256, arg_max(p->>'$.media.sourceEntryId', seq) AS "sourceEntryId", min(seq) AS pos FROM ev WHERE type = 'MEDIA_IMPORTED' GROUP BY 1
""")
def view_media(spark, folder):
    return views.media(events(spark, folder)).select("mediaId", "sha256", "sourceEntryId", "pos")


@query(f"""
    WITH {EVENTS_SQL}
    SELECT p->>'$.media.sha256' AS sha256, arg_max(p->>'$.media.mediaId', seq) AS "mediaId", min(seq) AS pos FROM ev WHERE type = 'MEDIA_IMPORTED' AND p->>'$.media.sha256' IS NOT NULL GROUP BY 1
""")
def view_media_by_sha(spark, folder):
    return views.media(events(spark, folder), "sha256").select("sha256", "mediaId", "pos")


@query(f"""
    WITH {EVENTS_SQL}, im AS (SELECT p->>'$.media.sourceEntryId' AS id, p->>'$.media.mediaId' AS media, seq FROM ev WHERE type = 'MEDIA_IMPORTED'),
    l AS (SELECT mediaId, sourceEntryId AS id, lower(trim(level)) AS level, CAST(floor(createdAt) AS BIGINT) AS seq FROM duplicate_link)
    SELECT mediaId AS "mediaId", level FROM l WHERE mediaId IS NOT NULL
    UNION SELECT arg_max(media, im.seq), level FROM l JOIN im USING (id) WHERE im.seq < l.seq GROUP BY l.seq, level, l.id
""")
def view_index_levels(spark, folder):
    """Levels of the incremental index: the log's imports and links made after them."""
    return views.import_levels(all_events(spark, folder))


def all_events(spark: SparkSession, folder: str) -> DataFrame:
    """The log's events and, behind them in position, the made ones."""
    return events(spark, folder).unionByName(made_events(spark, folder))


_LINK_KEY = "coalesce(mediaId, '') || '>' || coalesce(sourceEntryId, '') || '>' || coalesce(level, '')"
_KEYS = {"source": "sourceId", "sourceEntry": "sourceEntryId", "media": "mediaId", "ingestStatus": "sourceEntryId", "metadata": "mediaId", "duplicateLink": _LINK_KEY, "quarantine": "quarantineId", "album": "albumId"}
_SHOWN = {"source": "path", "sourceEntry": "state", "media": "sha256", "ingestStatus": "status", "metadata": "mimeType", "duplicateLink": "level", "quarantine": "status", "album": "name"}


def _whole_state_sql() -> str:
    named = {"source": "view_sources", "sourceEntry": "view_entries", "media": "view_media", "ingestStatus": "view_ingest_status", "metadata": "view_metadata", "duplicateLink": "view_links", "quarantine": "view_quarantine", "album": "view_albums"}
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, {_KEYS[k]} AS id, {_SHOWN[k]} AS shown FROM ({ORACLES[v]})" for k, v in named.items())


@query(_whole_state_sql())
def snapshot_union(spark, folder):
    """All eight tables as the records of one snapshot, read back by kind."""
    records = log.snapshot_union(views.domain_views(all_events(spark, folder)))
    keyed = shown = F.lit(None).cast("string")
    field = lambda name: F.get_json_object("record", f"$.{name}")
    for kind, key in _KEYS.items():
        own = F.concat_ws(">", *[F.coalesce(field(n), F.lit("")) for n in ("mediaId", "sourceEntryId", "level")]) if kind == "duplicateLink" else field(key)
        keyed = F.when(F.col("kind") == kind, own).otherwise(keyed)
        shown = F.when(F.col("kind") == kind, field(_SHOWN[kind])).otherwise(shown)
    return records.select("kind", keyed.alias("id"), shown.alias("shown"))


@query(_whole_state_sql())
def snapshot_plus_tail(spark, folder):
    """All eight tables rebuilt from a snapshot of what the log held at half its way and the events after it."""
    work = Workspace(spark, "rebuild")
    everything = work.save(all_events(spark, folder), "events")
    log_end = table(spark, folder, "wal_record").agg(F.max("seq")).head()[0] or 0
    # Made events lie far behind the log's in position, so each part is cut at its own half.
    made_half = everything.where(F.col("seq") > log_end).agg(F.percentile_approx("seq", 0.5)).head()[0] or 0
    early = (F.col("seq") <= log_end // 2) | ((F.col("seq") > log_end) & (F.col("seq") <= made_half))
    records = work.save(log.snapshot_union(views.domain_views(everything.where(early))), "snapshot")
    out = None
    for kind, rows in views.rebuild(records, everything.where(~early)).items():
        one = rows.select(F.lit(kind).alias("kind"), F.expr(_KEYS[kind]).alias("id"), F.col(_SHOWN[kind]).alias("shown"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    WITH first AS (SELECT seq, min(hash) AS hash FROM wal_record GROUP BY 1),
    l AS (SELECT w.seq, w.schemaVersion = 1 AS version_ok, (w.seq = 1 OR b.seq IS NOT NULL) AND c.n = 1 AS seq_ok, w.prevHash IS NOT DISTINCT FROM b.hash AS prev_ok
          FROM wal_record w LEFT JOIN first b ON b.seq = w.seq - 1 JOIN (SELECT seq, count(*) AS n FROM wal_record GROUP BY 1) c ON c.seq = w.seq)
    SELECT version_ok, seq_ok, prev_ok, count(*) AS n FROM l GROUP BY ALL
""")
def log_chain_check(spark, folder):
    rows = table(spark, folder, "wal_record").withColumn("line", F.lit(None).cast("string"))
    return log.checks(rows).groupBy("version_ok", "seq_ok", "prev_ok").agg(F.count("*").alias("n"))


@query()
def log_signed(spark, folder):
    """HMACs of the log's event payloads in canonical form."""
    rows = table(spark, folder, "wal_record").select("seq", "event.payload").distinct()
    return rows.select("seq", log.hmac_sha256(log._unsigned("payload"), b"test-secret").alias("mac"))


@query("SELECT name, rank FROM (SELECT CAST(sourceId AS VARCHAR) AS name, row_number() OVER (ORDER BY createdAt DESC, sourceId) AS rank FROM (SELECT sourceId, max(createdAt) AS createdAt FROM media_source GROUP BY 1)) WHERE rank <= 5")
def retention_topn(spark, folder):
    names = table(spark, folder, "media_source").groupBy(F.col("sourceId").alias("name")).agg(F.max("createdAt").alias("mtime"))
    kept = log.retained(names, None, 5)  # five rows
    ordered = kept.agg(F.array_sort(F.collect_list(F.struct((-F.col("mtime")).alias("age"), "name"))).alias("rows"))
    return ordered.select(F.posexplode("rows").alias("at", "r")).select("r.name", (F.col("at") + 1).cast("bigint").alias("rank"))


# Pipeline


@query(f"""
    WITH {_entries_sql('c', 1)}, {_entries_sql('l')},
    k AS (SELECT sourceId || '/' || path AS path, max(sourceEntryId) AS id, arg_max(size, sourceEntryId) AS size, arg_max(mtimeMs, sourceEntryId) AS mtimeMs, arg_max(state, sourceEntryId) AS state FROM c WHERE path IS NOT NULL GROUP BY 1),
    s AS (SELECT sourceId || '/' || path AS path, arg_max(size, sourceEntryId) AS size, arg_max(mtimeMs, sourceEntryId) AS mtimeMs FROM l WHERE path IS NOT NULL GROUP BY 1)
    SELECT path, id AS "sourceEntryId", CASE WHEN s.path IS NULL THEN 'missing' WHEN k.path IS NULL THEN 'new'
           WHEN s.size IS NOT DISTINCT FROM k.size AND s.mtimeMs IS NOT DISTINCT FROM k.mtimeMs THEN 'unchanged' ELSE 'changed' END AS outcome
    FROM s FULL JOIN k USING (path) WHERE s.path IS NOT NULL OR k.state IS DISTINCT FROM 'missing'
""")
def scan_diff(spark, folder):
    def files(back):
        rows = latest_entries(spark, folder, back=back).where("path is not null")
        keyed = rows.groupBy(F.concat_ws("/", "sourceId", "path").alias("path"))
        return keyed.agg(F.max(F.struct("sourceEntryId", "size", "mtimeMs", "state")).alias("r")).select("path", "r.*")

    return pipeline.scan_diff(files(0).select("path", "size", "mtimeMs"), files(1))


def _keyed_sql(name: str, back: int = 0) -> str:
    return f"""{name} AS (SELECT key, max(sourceEntryId) AS id, arg_max(size, sourceEntryId) AS size, arg_max(mtimeMs, sourceEntryId) AS mtimeMs, arg_max(state, sourceEntryId) AS state
        FROM (SELECT sourceEntryId, r.size AS size, r.mtimeMs AS mtimeMs, r.state AS state,
                     CASE WHEN r.archivePath IS NOT NULL AND r.innerPath IS NOT NULL THEN r.sourceId || ':archive:' || r.archivePath || '::' || r.innerPath
                          ELSE r.sourceId || ':file:' || coalesce(r.path, '') END AS key
              FROM (SELECT sourceEntryId, max(struct_pack(seen := lastSeenAt, sourceId := sourceId, path := path, size := size, mtimeMs := mtimeMs, state := state,
                                                          fingerprint := fingerprint, archivePath := archivePath, innerPath := innerPath)) AS r
                    FROM entry_snapshot WHERE snapshotNo = {_newest(back)} AND sourceEntryId IS NOT NULL GROUP BY 1)) GROUP BY 1)"""


@query(f"""
    WITH {_keyed_sql('k', 1)}, {_keyed_sql('s')}
    SELECT key, k.id AS "sourceEntryId", CASE WHEN s.id IS NULL THEN 'missing' WHEN k.id IS NULL THEN 'new'
           WHEN s.size IS NOT DISTINCT FROM k.size AND s.mtimeMs IS NOT DISTINCT FROM k.mtimeMs THEN 'unchanged' ELSE 'changed' END AS outcome
    FROM s FULL JOIN k USING (key) WHERE s.id IS NOT NULL OR k.state IS DISTINCT FROM 'missing'
""")
def scan_diff_all(spark, folder):
    """scan_diff over entries of every kind, by natural key."""

    def entries(back):
        rows = latest_entries(spark, folder, "archivePath", "innerPath", back=back)
        key = S.natural_key(*(F.col(c) for c in ("sourceId", "path", "archivePath", "innerPath")))
        keyed = rows.groupBy(key.alias("path"))
        return keyed.agg(F.max(F.struct("sourceEntryId", "size", "mtimeMs", "state")).alias("r")).select("path", "r.*")

    return pipeline.scan_diff(entries(0).select("path", "size", "mtimeMs"), entries(1)).withColumnRenamed("path", "key")


@query(f"""
    WITH v AS (SELECT mediaId, min(batchNo) AS b, max(lower(trim(sha256))) AS sha FROM media WHERE regexp_full_match(lower(trim(sha256)), '[0-9a-f]{{64}}') GROUP BY 1),
    known AS (SELECT sha, min(mediaId) AS old FROM v WHERE b = 1 GROUP BY 1),
    f AS (SELECT sha, min(mediaId) AS first FROM v WHERE b > 1 GROUP BY 1)
    SELECT v.mediaId AS entry, v.sha AS sha256, old IS NULL AND v.mediaId = first AS imported,
           CASE WHEN NOT (old IS NULL AND v.mediaId = first) THEN coalesce(old, first) END AS original
    FROM v JOIN f USING (sha) LEFT JOIN known USING (sha) WHERE b > 1
""")
def exact_dedup(spark, folder):
    """Media of later batches against those of the first."""
    m = table(spark, folder, "media").select("mediaId", "batchNo", S.sha256_hex("sha256").alias("sha256")).where("sha256 is not null")
    m = m.groupBy("mediaId").agg(F.min("batchNo").alias("b"), F.max("sha256").alias("sha256"))
    incoming = m.where("b > 1").select(F.col("mediaId").alias("entry"), "sha256", F.col("mediaId").alias("rank"))
    return pipeline.exact_dedup(incoming, m.where("b = 1").select("sha256", "mediaId"))


def _near_items(spark, folder):
    raw = F.try_variant_get(F.try_parse_json("raw"), "$.perceptualHash", "string")
    hashes = current(spark, folder).select("mediaId", S.perceptual_hash(raw).alias("phash"))
    heads = latest_entries(spark, folder).select(F.col("sourceEntryId"), S.head_key("fingerprint").alias("head"), "state")
    rows = media_rows(spark, folder).join(hashes, "mediaId").where("phash is not null").join(heads, "sourceEntryId", "left")
    return rows.select(F.col("mediaId").alias("entry"), "mediaId", "head", "phash", F.lit("active").alias("state"), F.col("mediaId").alias("rank"))


NEAR_SQL = f"""
    WITH {CURRENT_SQL}, {MEDIA_SQL}, {_entries_sql('e')},
    i AS (SELECT m.mediaId AS id, lower(trim(try_cast(c.raw AS JSON)->>'$.perceptualHash')) AS h,
                 CASE WHEN len(string_split(e.fingerprint, ':')) = 3 AND try_cast(split_part(e.fingerprint, ':', 1) AS BIGINT) IS NOT NULL AND split_part(e.fingerprint, ':', 3) <> ''
                      THEN split_part(e.fingerprint, ':', 1) || ':' || split_part(e.fingerprint, ':', 3) END AS head
          FROM m JOIN current c USING (mediaId) LEFT JOIN e USING (sourceEntryId)
          WHERE regexp_full_match(lower(trim(try_cast(c.raw AS JSON)->>'$.perceptualHash')), '[0-9a-f]{{16}}')),
    p AS (SELECT a.id, b.id AS candidate, CASE WHEN a.head = b.head THEN 0 ELSE 1 END AS way,
                 bit_count(xor(CAST('0x' || a.h AS UBIGINT), CAST('0x' || b.h AS UBIGINT))) AS d
          FROM i a JOIN i b ON a.id <> b.id AND left(a.h, 4) = left(b.h, 4)
          UNION SELECT a.id, b.id, 0, bit_count(xor(CAST('0x' || a.h AS UBIGINT), CAST('0x' || b.h AS UBIGINT))) FROM i a JOIN i b ON a.id <> b.id AND a.head = b.head),
    q AS (SELECT id, candidate, min(way) AS way, min(d) AS d FROM p WHERE d <= 10 GROUP BY 1, 2)
"""


@query(NEAR_SQL + "SELECT id AS entry, candidate, CAST(d AS INTEGER) AS distance FROM q")
def near_dup_pairs(spark, folder):
    pairs = pipeline.near_pairs(_near_items(spark, folder), 10)
    return pairs.select("entry", "candidate", F.col("distance").cast("int").alias("distance"))


@query(NEAR_SQL + """
    SELECT id AS entry, CASE WHEN min(d) <= 4 THEN 'strong' ELSE 'quarantine' END AS outcome,
           arg_min(candidate, struct_pack(d := d, way := way, c := candidate)) FILTER (d <= 4) AS "mediaId", CAST(min(d) FILTER (d <= 4) AS INTEGER) AS distance,
           CASE WHEN min(d) > 4 THEN id || ',' || string_agg(candidate, ',' ORDER BY way, candidate) END AS candidates
    FROM q GROUP BY id
""")
def near_dup_classified(spark, folder):
    found = pipeline.classify_near(_near_items(spark, folder))
    return found.select("entry", "outcome", "mediaId", F.col("distance").cast("int").alias("distance"), F.array_join("candidateMediaIds", ",").alias("candidates"))


def _near_items_all(spark, folder):
    """Every media with an entry, by the entry's state; a media without one is neither decided nor a candidate, as in the reference."""
    raw = F.try_variant_get(F.try_parse_json("raw"), "$.perceptualHash", "string")
    hashes = current(spark, folder).select("mediaId", S.perceptual_hash(raw).alias("phash"))
    heads = latest_entries(spark, folder).select("sourceEntryId", S.head_key("fingerprint").alias("head"), "state")
    rows = media_rows(spark, folder).join(heads, "sourceEntryId").join(hashes, "mediaId", "left")
    return rows.select(F.col("mediaId").alias("entry"), "mediaId", "head", "phash", "state", F.col("mediaId").alias("rank"))


NEAR_ALL_SQL = f"""
    WITH {CURRENT_SQL}, {MEDIA_SQL}, {_entries_sql('e')},
    t AS (SELECT m.mediaId AS id, e.state, e.fingerprint, lower(trim(try_cast(c.raw AS JSON)->>'$.perceptualHash')) AS text
          FROM m JOIN e USING (sourceEntryId) LEFT JOIN current c USING (mediaId)),
    i AS (SELECT id, state, CASE WHEN regexp_full_match(text, '[0-9a-f]{{16}}') THEN text END AS h,
                 CASE WHEN len(string_split(fingerprint, ':')) = 3 AND try_cast(split_part(fingerprint, ':', 1) AS BIGINT) IS NOT NULL AND split_part(fingerprint, ':', 3) <> ''
                      THEN split_part(fingerprint, ':', 1) || ':' || split_part(fingerprint, ':', 3) END AS head FROM t),
    p AS (SELECT a.id, a.h, b.id AS candidate, b.h AS other, 0 AS way FROM i a JOIN i b ON a.id <> b.id AND a.head = b.head WHERE b.state = 'active'
          UNION ALL SELECT a.id, a.h, b.id, b.h, 1 FROM i a JOIN i b ON a.id <> b.id AND left(a.h, 4) = left(b.h, 4) WHERE b.state = 'active'),
    q AS (SELECT id, candidate, min(way) AS way, min(d) AS d
          FROM (SELECT *, bit_count(xor(CAST('0x' || h AS UBIGINT), CAST('0x' || other AS UBIGINT))) AS d FROM p) WHERE h IS NULL OR d <= 10 GROUP BY 1, 2)
"""


@query(NEAR_ALL_SQL + "SELECT id AS entry, candidate, CAST(d AS INTEGER) AS distance FROM q")
def near_dup_pairs_all(spark, folder):
    """near_dup_pairs over all media, those without a perceptual hash by head key; only active entries are candidates."""
    pairs = pipeline.near_pairs(_near_items_all(spark, folder), 10)
    return pairs.select("entry", "candidate", F.col("distance").cast("int").alias("distance"))


@query(NEAR_ALL_SQL + """
    SELECT id AS entry, CASE WHEN min(d) <= 4 THEN 'strong' ELSE 'quarantine' END AS outcome,
           arg_min(candidate, struct_pack(d := d, way := way, c := candidate)) FILTER (d <= 4) AS "mediaId", CAST(min(d) FILTER (d <= 4) AS INTEGER) AS distance,
           CASE WHEN coalesce(min(d) > 4, true) THEN id || ',' || string_agg(candidate, ',' ORDER BY way, candidate) END AS candidates
    FROM q GROUP BY id
""")
def near_dup_classified_all(spark, folder):
    found = pipeline.classify_near(_near_items_all(spark, folder))
    return found.select("entry", "outcome", "mediaId", F.col("distance").cast("int").alias("distance"), F.array_join("candidateMediaIds", ",").alias("candidates"))


@query(f"""
    WITH {CURRENT_SQL}, {MEDIA_SQL}, {LINKS_SQL}
    SELECT m.mediaId AS "mediaId", c.kind, c.mimeType AS "mimeType", l.links
    FROM m LEFT JOIN current c USING (mediaId)
         LEFT JOIN (SELECT mediaId, string_agg(level || '>' || sourceEntryId, ',' ORDER BY level, sourceEntryId) AS links FROM links GROUP BY 1) l USING (mediaId)
""")
def media_detail(spark, folder):
    rows = pipeline.media_detail(media_rows(spark, folder), current(spark, folder), link_rows(spark, folder))
    shown = F.array_join(F.transform("links", lambda x: F.concat_ws(">", x["level"], x["sourceEntryId"])), ",")
    return rows.select("mediaId", "kind", "mimeType", shown.alias("links"))


@query(f"""
    WITH {CURRENT_SQL}, {MEDIA_SQL}, {LINKS_SQL}, {_entries_sql('e')}, one AS (SELECT sourceEntryId, min(mediaId) AS mediaId FROM m GROUP BY 1),
    q AS (SELECT sourceEntryId, min(quarantineId) AS quarantineId FROM quarantine_item GROUP BY 1)
    SELECT e.sourceEntryId AS "sourceEntryId", CASE WHEN one.mediaId IS NULL THEN 'none' ELSE 'imported' END AS status, one.mediaId AS "ownMediaId",
           c.kind AS "mediaKind", q.quarantineId AS "quarantineId", coalesce(l.n, 0) AS links
    FROM e LEFT JOIN one USING (sourceEntryId) LEFT JOIN current c ON c.mediaId = one.mediaId LEFT JOIN q USING (sourceEntryId)
         LEFT JOIN (SELECT sourceEntryId, count(*) AS n FROM links GROUP BY 1) l USING (sourceEntryId)
""")
def entry_detail(spark, folder):
    media = media_rows(spark, folder).groupBy("sourceEntryId").agg(F.min_by(F.struct("mediaId", "sha256"), "mediaId").alias("r")).select("sourceEntryId", "r.*")
    ingest = media.select("sourceEntryId", F.lit("imported").alias("status"))
    held = table(spark, folder, "quarantine_item").groupBy("sourceEntryId").agg(F.min("quarantineId").alias("quarantineId"))
    rows = pipeline.entry_detail(latest_entries(spark, folder), ingest, media, current(spark, folder), held, link_rows(spark, folder))
    return rows.select("sourceEntryId", "status", "ownMediaId", "mediaKind", "quarantineId", F.coalesce(F.size("links"), F.lit(0)).cast("bigint").alias("links"))


@query("""
    SELECT DISTINCT quarantineId AS "albumId", i AS "mediaId" FROM (SELECT quarantineId, unnest(candidateMediaIds) AS i FROM quarantine_item)
    WHERE i IS NOT NULL AND i NOT IN (SELECT mediaId FROM media WHERE mediaId IS NOT NULL)
""")
def album_members_missing(spark, folder):
    lists = table(spark, folder, "quarantine_item").select(F.col("quarantineId").alias("albumId"), F.filter("candidateMediaIds", lambda x: x.isNotNull()).alias("mediaIds"))
    return pipeline.missing_members(lists, media_rows(spark, folder))


@query("""
    SELECT DISTINCT mediaId AS "mediaId", CASE kind WHEN 'photo' THEN 'thumb' ELSE 'poster' END AS asset FROM media_metadata
    WHERE kind IN ('photo', 'video') AND mediaId NOT IN (SELECT mediaId FROM media WHERE batchNo = 1)
""")
def derived_plan(spark, folder):
    present = table(spark, folder, "media").where("batchNo = 1").select("mediaId", F.explode(F.array(F.lit("thumb"), F.lit("poster"))).alias("asset"))
    return pipeline.derived_plan(table(spark, folder, "media_metadata"), present)


@query("""
    SELECT DISTINCT sha AS sha256, 'media/sha256/' || left(sha, 2) || '/' || substr(sha, 3, 2) || '/' || sha AS path
    FROM (SELECT lower(trim(sha256)) AS sha, batchNo FROM media) WHERE regexp_full_match(sha, '[0-9a-f]{64}') AND batchNo > 6
      AND sha NOT IN (SELECT lower(trim(sha256)) FROM media WHERE batchNo <= 6 AND sha256 IS NOT NULL)
""")
def vault_new_contents(spark, folder):
    m = table(spark, folder, "media").select(S.sha256_hex("sha256").alias("sha256"), "batchNo")
    return pipeline.new_contents(m.where("batchNo > 6"), m.where("batchNo <= 6"))


@query("""
    WITH c AS (SELECT quarantineId, status, acceptedMediaId, createdAt FROM quarantine_item WHERE status <> 'pending'),
    f AS (SELECT quarantineId, arg_min(status, createdAt) AS status, arg_min(coalesce(acceptedMediaId, ''), createdAt) AS media FROM c GROUP BY 1),
    p AS (SELECT quarantineId, any_value(candidateMediaIds) AS ids FROM (SELECT DISTINCT quarantineId, candidateMediaIds FROM quarantine_item WHERE status = 'pending') GROUP BY 1 HAVING count(*) = 1)
    SELECT f.quarantineId AS "quarantineId", CASE WHEN p.quarantineId IS NULL THEN 'not_found' WHEN f.status = 'accepted' AND NOT coalesce(list_contains(p.ids, f.media), false) THEN 'not_a_candidate' END AS error
    FROM f LEFT JOIN p USING (quarantineId)
""")
def quarantine_decisions(spark, folder):
    q = table(spark, folder, "quarantine_item")
    action = F.when(F.col("status") == "accepted", "accept").otherwise("reject")
    commands = q.where("status <> 'pending'").select("quarantineId", action.alias("action"), F.coalesce("acceptedMediaId", F.lit("")).alias("mediaId"), F.col("createdAt").alias("at"))
    items = q.where("status = 'pending'").select("quarantineId", "candidateMediaIds").distinct()
    single = items.groupBy("quarantineId").agg(F.first("candidateMediaIds").alias("candidateMediaIds"), F.count("*").alias("n")).where("n = 1")
    return pipeline.decide(single.withColumn("status", F.lit("pending")), commands).select("quarantineId", "error")


@query("""
    SELECT (SELECT count(*) FROM media_source) AS sources, (SELECT count(*) FROM media) AS media,
           (SELECT count(*) FROM quarantine_item WHERE status = 'pending') AS "quarantinePending", (SELECT count(*) FROM duplicate_link) AS links
""")
def app_metrics(spark, folder):
    t = lambda n: table(spark, folder, n)
    return pipeline.metrics({"sources": (t("media_source"), None), "media": (t("media"), None), "quarantinePending": (t("quarantine_item"), F.col("status") == "pending"), "links": (t("duplicate_link"), None)})


@query("""
    WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, min(v) AS min_v, max(v) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(v) AS max_v, round(avg(v), 6) AS avg_v
    FROM r GROUP BY 1
""")
def latency_percentiles(spark, folder):
    return pipeline.latency_stats(table(spark, folder, "events"), "event_type", "value").withColumn("avg_v", F.round("avg_v", 6))


@query("""
    WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    s AS (SELECT event_type, max(v) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, avg(v) AS a FROM r GROUP BY 1)
    SELECT event_type AS name, printf('p95 %.2f > 10.00', p95) AS violation FROM s WHERE p95 > 10
    UNION ALL SELECT event_type, printf('avg %.2f > 5.00', a) FROM s WHERE a > 5
""")
def perf_budget(spark, folder):
    return pipeline.budget_violations(pipeline.latency_stats(table(spark, folder, "events"), "event_type", "value"), "event_type", 10.0, 5.0)


# Scalars


@query("""
    SELECT DISTINCT fingerprint, CASE WHEN len(string_split(fingerprint, ':')) = 3 AND try_cast(split_part(fingerprint, ':', 1) AS BIGINT) IS NOT NULL AND split_part(fingerprint, ':', 3) <> ''
           THEN CAST(CAST(split_part(fingerprint, ':', 1) AS BIGINT) AS VARCHAR) || ':' || split_part(fingerprint, ':', 3) END AS head FROM entry_snapshot WHERE fingerprint IS NOT NULL
""")
def fingerprint_parse(spark, folder):
    rows = table(spark, folder, "entry_snapshot").where("fingerprint is not null").select("fingerprint").distinct()
    return rows.select("fingerprint", S.head_key("fingerprint").alias("head"))


def _case(table_: dict[str, str], ext: str) -> str:
    return f"CASE {ext} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '^.+?(\\.[^.]*)$', 1))"


@query(f"""
    SELECT DISTINCT path, {_case(dict.fromkeys(S.PHOTO_EXTENSIONS, 'photo') | dict.fromkeys(S.VIDEO_EXTENSIONS, 'video'), _EXT).replace(' END', " ELSE 'unknown' END")} AS kind,
           {_case(S.METADATA_MIME, _EXT)} AS mime, {_case(S.SERVED_MIME, _EXT).replace(' END', " ELSE 'application/octet-stream' END")} AS served
    FROM entry_snapshot WHERE path IS NOT NULL
""")
def mime_kind(spark, folder):
    rows = table(spark, folder, "entry_snapshot").where("path is not null").select("path").distinct()
    return rows.select("path", S.media_kind("path").alias("kind"), S.metadata_mime("path").alias("mime"), S.served_mime("path").alias("served"))


@query("""
    WITH p AS (SELECT DISTINCT path FROM entry_snapshot WHERE path IS NOT NULL),
    l AS (SELECT path, array_to_string(string_split(path, '/')[1:n], '/') AS part FROM p, unnest(range(1, len(string_split(path, '/')) + 1)) AS t(n))
    SELECT path, bool_or(regexp_full_match(part, '201.|20../[^/]*a[^/]*|[^/]*a[^/]*|.*\\.png|.*\\.PNG')) AS excluded FROM l GROUP BY 1
""")
def glob_filter(spark, folder):
    rows = table(spark, folder, "entry_snapshot").where("path is not null").select("path").distinct()
    return rows.select("path", S.excluded("path", ["201?", "20??/*a*", "*a*", "**.png", "**.PNG"]).alias("excluded"))


@query("SELECT c_custkey, printf('%.1f', floor(c_acctbal / 100 * 10) / 10) || ':' || printf('%.1f', floor(c_acctbal / 77 * 10) / 10) AS tile FROM customer")
def gps_tile(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.gps_tile(F.col("c_acctbal") / 100, F.col("c_acctbal") / 77).alias("tile"))


@query("SELECT DISTINCT createdAt AS ms, strftime(make_timestamp(CAST(floor(createdAt) AS BIGINT) * 1000), '%Y-%m-%d') AS day FROM duplicate_link")
def taken_day(spark, folder):
    return table(spark, folder, "duplicate_link").select(F.col("createdAt").alias("ms"), S.taken_day("createdAt").alias("day")).distinct()


_PIXEL = "CAST(round(embedding[({i}) % 64 + 1] * 1000) AS INTEGER)"
_BITS = "list_aggregate([CASE WHEN " + _PIXEL.format(i="i // 8 * 9 + i % 8") + " > " + _PIXEL.format(i="i // 8 * 9 + i % 8 + 1") + " THEN 1 ELSE 0 END for i in range(64)], 'string_agg', '')"


@query(f"SELECT vec_id, {_BITS} AS bits FROM embeddings")
def sign_bits(spark, folder):
    """Difference hashes of embeddings as grey values of 9 x 8 pixels, the first ones again at the end; shown as bits."""
    value = lambda i: F.round(F.get("embedding", (i % 64).cast("int")) * 1000).cast("int")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), value)
    code = S.code_of_hex(S.dhash64(pixels))
    return table(spark, folder, "embeddings").select("vec_id", F.lpad(F.bin(code), 64, "0").alias("bits"))


@query("SELECT quarantineId AS id, (SELECT string_agg(x, ',' ORDER BY spot) FROM (SELECT x, min(i) AS spot FROM (SELECT trim(candidateMediaIds[i], ' \t') AS x, i FROM unnest(range(1, len(candidateMediaIds) + 1)) AS t(i)) WHERE x <> '' GROUP BY x)) AS ids FROM quarantine_item WHERE candidateMediaIds IS NOT NULL")
def array_ordered_distinct(spark, folder):
    rows = table(spark, folder, "quarantine_item").where("candidateMediaIds is not null")
    joined = S.ordered_distinct("candidateMediaIds")
    return rows.select(F.col("quarantineId").alias("id"), F.when(F.size(joined) > 0, F.array_join(joined, ",")).alias("ids"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(30000, 500 * pow(2, l_linenumber - 1)) AS BIGINT) AS delay FROM lineitem")
def backoff(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", S.retry_delay_ms(F.col("l_linenumber")).alias("delay"))


@query("""
    SELECT mediaId AS "mediaId", CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f GB', size / 1073741824.0) END AS shown
    FROM (SELECT DISTINCT mediaId, size FROM media WHERE size IS NOT NULL)
""")
def format_bytes(spark, folder):
    rows = table(spark, folder, "media").where("size is not null").select("mediaId", "size").distinct()
    return rows.select("mediaId", S.format_bytes(F.col("size")).alias("shown"))


@query("SELECT event_id, 64 * value AS v, CAST(bit_count(xor(CAST(event_id AS UBIGINT), CAST(user_id AS UBIGINT))) AS INTEGER) AS bits FROM events")
def hamming(spark, folder):
    h = lambda c: F.lpad(F.hex(c), 16, "0")
    rows = table(spark, folder, "events")
    return rows.select("event_id", (F.col("value") * 64).alias("v"), S.hamming(h("event_id"), h("user_id")).cast("int").alias("bits"))


@query("SELECT i, repeat(lpad(lower(to_hex(i)), 8, '0'), 8) AS sha FROM (SELECT o_orderkey AS i FROM orders)")
def bench_sha(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("i"), S.bench_sha(F.col("o_orderkey")).alias("sha"))


@query("SELECT DISTINCT level, CASE WHEN lower(trim(level)) IN ('exact', 'strong', 'probable') THEN lower(trim(level)) END AS known FROM duplicate_link")
def level_normalized(spark, folder):
    return table(spark, folder, "duplicate_link").select("level", S.duplicate_level("level").alias("known")).distinct()


# Extraction, digests and reports


@query(f"""
    WITH {CURRENT_SQL},
    m AS (SELECT mediaId, kind, width, height, durationMs, cameraModel, epoch_ms(date_trunc('second', extractedAt)) AS taken, (mediaId LIKE '%0' OR mediaId LIKE '%1' OR kind NOT IN ('photo', 'video')) AS failed FROM current)
    SELECT mediaId AS "mediaId", kind, CASE WHEN failed OR kind = 'video' AND mediaId LIKE '%2' THEN 1000.0 ELSE CAST(taken AS DOUBLE) END AS "takenAt", CASE WHEN NOT failed THEN width END AS width, CASE WHEN NOT failed THEN height END AS height,
           CASE WHEN NOT failed AND kind = 'video' THEN durationMs END AS "durationMs", CASE WHEN NOT failed AND kind = 'photo' THEN nullif(trim(cameraModel), '') END AS "cameraModel",
           CASE kind WHEN 'photo' THEN CASE WHEN failed THEN 'image/jpeg' ELSE 'image/x-own' END WHEN 'video' THEN CASE WHEN failed THEN 'video/quicktime' ELSE 'video/mp4' END END AS "mimeType",
           CASE WHEN failed THEN NULL WHEN kind = 'photo' THEN 'exiftool' ELSE 'ffprobe' END AS extractor, CASE kind WHEN 'photo' THEN '.jpg' WHEN 'video' THEN '.mov' ELSE '.txt' END AS ext
    FROM m
""")
def metadata_extracted(spark, folder):
    """Metadata from what tools print, made from the table's fields; a fifth of the outputs is missing or cut off."""
    m = current(spark, folder)
    t = F.col("extractedAt").cast("timestamp")
    photo = F.to_json(F.array(F.struct(F.col("width").alias("ImageWidth"), F.col("height").cast("string").alias("ImageHeight"), F.col("cameraModel").alias("Model"), F.date_format(t, "yyyy:MM:dd HH:mm:ss").alias("DateTimeOriginal"), F.lit("image/x-own").alias("MIMEType"), F.array(F.lit(1)).alias("Dropped"))))
    made = F.when(~F.col("mediaId").endswith("2"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    streams = F.array(F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")), F.struct(F.lit("video").alias("codec_type"), F.col("width"), F.col("height")))
    seconds = F.format_string("%.3f", F.col("durationMs") / F.lit(1000.0))
    form = F.struct(F.when(F.col("durationMs").isNotNull(), seconds).alias("duration"), F.lit("mov,mp4,m4a").alias("format_name"), F.struct(made.alias("creation_time")).alias("tags"))
    whole = F.when(F.col("kind") == "photo", photo).otherwise(F.to_json(F.struct(streams.alias("streams"), form.alias("format"))))
    output = F.when(F.col("mediaId").endswith("0"), None).when(F.col("mediaId").endswith("1"), "{cut").otherwise(whole)
    path = F.concat("mediaId", F.when(F.col("kind") == "photo", ".JPG").when(F.col("kind") == "video", ".mov").otherwise(".txt"))
    files = m.select("mediaId", path.alias("path"), F.lit(1000.0).alias("mtimeMs"), output.alias("toolOutput"), F.lit(None).cast("array<int>").alias("pixels"))
    found = extraction.extract(files)
    raw = lambda name: F.get_json_object("metadata.raw", f"$.{name}").alias(name)
    return found.select("mediaId", *[F.col(f"metadata.{f}").alias(f) for f in extraction.FIELDS], raw("extractor"), raw("ext"))


@query("SELECT s_suppkey, sha256(repeat(s_name, 5000)) AS sha256, sha256(left(repeat(s_name, 5000), 65536)) AS head FROM supplier")
def file_digests(spark, folder):
    content = F.encode(F.repeat("s_name", F.lit(5000)), "UTF-8")
    return table(spark, folder, "supplier").select("s_suppkey", S.file_sha256(content).alias("sha256"), S.head_sha256(content).alias("head"))


@query("""
    SELECT event_id, 'case ' || event_type AS name, user_id AS "resultSize", round(value, 2) AS "minMs", round(value + 2, 2) AS "maxMs" FROM events WHERE value >= 0 AND event_type <> 'click'
""")
def bench_lines(spark, folder):
    """Lines of the benchmark's report read back; other lines give nothing."""
    e = table(spark, folder, "events").where("value is not null")
    v = lambda add: F.format_string("%.2f", F.round(F.col("value") + add, 2))
    line = F.format_string("case %s | result=%d | min=%sms | p50=%sms | p95=%sms | avg=%sms | max=%sms", "event_type", "user_id", v(0), v(0), v(1), v(1), v(2))
    read = e.select("event_id", S.bench_line(F.when(F.col("event_type") == "click", F.lit("# a heading")).otherwise(line)).alias("r"))
    return read.where("r is not null").select("event_id", "r.name", "r.resultSize", "r.minMs", "r.maxMs")


@query("SELECT DISTINCT status, CASE status WHEN 'accepted' THEN 'gray' ELSE 'gray' END AS colour FROM quarantine_item UNION SELECT * FROM (VALUES ('completed', 'green'), ('failed', 'red'), ('running', 'yellow'))")
def job_colours(spark, folder):
    known = table(spark, folder, "quarantine_item").select("status").unionByName(spark.createDataFrame([("completed",), ("failed",), ("running",)], "status string"))
    return known.distinct().select("status", S.job_colour(F.col("status")).alias("colour"))


# Events of jobs and commands


@query(f"""
    WITH {_keyed_sql('k', 1)}, {_keyed_sql('s')},
    b AS (SELECT coalesce(s.key, k.key) AS key, s.id IS NOT NULL AS listed, k.id AS entry, s.size, s.mtimeMs, k.state, coalesce(s.size = k.size AND s.mtimeMs = k.mtimeMs, false) AS same FROM s FULL JOIN k USING (key))
    SELECT key AS path, CASE WHEN listed THEN 'SOURCE_ENTRY_UPSERTED' ELSE 'SOURCE_ENTRY_MARKED_MISSING' END AS type, entry AS "knownEntry", CASE WHEN listed THEN 'active' ELSE 'missing' END AS state,
           CASE WHEN listed THEN CASE WHEN same THEN 'old' ELSE CAST(size AS VARCHAR) || ':' || CAST(CAST(floor(mtimeMs) AS BIGINT) AS VARCHAR) || ':h' END END AS fingerprint, listed AND NOT same AS ingest
    FROM b WHERE listed OR state IS DISTINCT FROM 'missing'
""")
def scan_emitted(spark, folder):
    """Events of a scan that lists the newest delivery against the one before."""

    def entries(back):
        rows = latest_entries(spark, folder, "archivePath", "innerPath", back=back)
        key = S.natural_key(*(F.col(c) for c in ("sourceId", "path", "archivePath", "innerPath")))
        keyed = rows.groupBy(key.alias("path"))
        return keyed.agg(F.max(F.struct("sourceEntryId", "size", "mtimeMs", "state")).alias("r")).select("path", "r.*")

    listed = entries(0).select("path", "size", "mtimeMs", F.lit("h").alias("head"))
    made = commands.scan_events(listed, entries(1).withColumn("fingerprint", F.lit("old")), "s", 5.0)
    known = F.when(F.col("sourceEntryId") != S.minted("se", F.lit("s"), F.col("path")), F.col("sourceEntryId"))
    return made.select("path", "type", known.alias("knownEntry"), "state", "fingerprint", "ingest")


_INGEST_SQL = """
    v AS (SELECT mediaId, min(batchNo) AS b, max(lower(trim(sha256))) AS sha FROM media WHERE regexp_full_match(lower(trim(sha256)), '[0-9a-f]{64}') GROUP BY 1),
    known AS (SELECT sha, min(mediaId) AS old FROM v WHERE b = 1 GROUP BY 1),
    inc AS (SELECT mediaId AS entry, sha FROM v WHERE b > 1 AND mediaId NOT LIKE '%7'),
    f AS (SELECT sha, min(entry) AS first FROM inc GROUP BY 1),
    d AS (SELECT entry, sha, old IS NULL AND entry = first AS imported, coalesce(old, first) AS original, old IS NOT NULL AS was FROM inc JOIN f USING (sha) LEFT JOIN known USING (sha))
"""


@query(f"""
    WITH {_INGEST_SQL}
    SELECT entry AS "sourceEntryId", 'MEDIA_SHA256_COMPUTED' AS type, NULL AS level, NULL AS reason, NULL AS "known" FROM d
    UNION ALL SELECT entry, 'MEDIA_IMPORTED', NULL, NULL, NULL FROM d WHERE imported
    UNION ALL SELECT entry, 'MEDIA_SKIPPED_DUPLICATE_EXACT', NULL, NULL, CASE WHEN was THEN original END FROM d WHERE NOT imported
    UNION ALL SELECT entry, 'DUPLICATE_LINK_CREATED', 'exact', 'sha256', CASE WHEN was THEN original END FROM d WHERE NOT imported
""")
def ingest_emitted(spark, folder):
    """Events of ingesting later batches against the first; a tenth was ingested before."""
    m = table(spark, folder, "media").select("mediaId", "batchNo", S.sha256_hex("sha256").alias("sha256")).where("sha256 is not null")
    m = m.groupBy("mediaId").agg(F.min("batchNo").alias("b"), F.max("sha256").alias("sha256"))
    status = F.when(F.col("mediaId").endswith("7"), "imported").otherwise("none")
    incoming = m.where("b > 1").select(F.col("mediaId").alias("entry"), "sha256", F.lit(1).cast("bigint").alias("size"), status.alias("status"), F.col("mediaId").alias("rank"))
    first = m.where("b = 1").select("sha256", "mediaId")
    made = commands.ingest_events(incoming, first)
    known = made.join(first.select(F.col("mediaId").alias("known")).distinct(), F.col("mediaId") == F.col("known"), "left")
    return known.select("sourceEntryId", "type", "level", "reason", "known")


_NEAR_STATE_SQL = """
    st AS (SELECT i.*, EXISTS (SELECT 1 FROM held WHERE held.mediaId = i.id) AS quarantined, EXISTS (SELECT 1 FROM strong WHERE strong.mediaId = i.id) AS linked FROM i),
    stop AS (SELECT DISTINCT a.id FROM st a JOIN st b ON a.id <> b.id AND b.quarantined AND b.state = 'active' AND (a.head = b.head OR left(a.h, 4) = left(b.h, 4))),
    open AS (SELECT id, linked FROM st WHERE NOT quarantined AND id NOT IN (SELECT id FROM stop)),
    o AS (SELECT q.id, min(d) AS least, arg_min(candidate, struct_pack(d := d, way := way, c := candidate)) FILTER (d <= 4) AS best, string_agg(candidate, ',' ORDER BY way, candidate) AS others FROM q GROUP BY 1)
"""


@query(NEAR_ALL_SQL.rstrip() + """,
    m2 AS (SELECT DISTINCT mediaId, sourceEntryId FROM media),
    held AS (SELECT m2.mediaId FROM m2 JOIN quarantine_item qi USING (sourceEntryId)),
    strong AS (SELECT m2.mediaId FROM m2 JOIN (SELECT DISTINCT sourceEntryId FROM duplicate_link WHERE lower(trim(level)) = 'strong' AND mediaId IS NOT NULL) l USING (sourceEntryId)),""" + _NEAR_STATE_SQL + """
    SELECT o.id AS "sourceEntryId", CASE WHEN best IS NOT NULL THEN 'DUPLICATE_LINK_CREATED' ELSE 'QUARANTINE_CREATED' END AS type, best AS "mediaId", CASE WHEN best IS NOT NULL THEN 'perceptual-hamming<=4:' || CAST(least AS VARCHAR) END AS reason,
           CASE WHEN best IS NULL THEN o.id || ',' || others END AS candidates
    FROM o JOIN open USING (id) WHERE best IS NULL OR NOT linked
""")
def near_dup_emitted(spark, folder):
    """Links and review items of near-duplicate jobs, decided on the review items and strong links that the tables hold."""
    m = media_rows(spark, folder).select("mediaId", "sourceEntryId")
    held = m.join(table(spark, folder, "quarantine_item").select("sourceEntryId"), "sourceEntryId", "left_semi").select(F.col("mediaId").alias("entry"), F.lit(True).alias("quarantined")).distinct()
    strong = m.join(link_rows(spark, folder).where("level = 'strong'"), "sourceEntryId", "left_semi").select(F.col("mediaId").alias("entry"), F.lit(True).alias("linked")).distinct()
    items = _near_items_all(spark, folder).join(held, "entry", "left").join(strong, "entry", "left").fillna(False, ["quarantined", "linked"]).withColumn("imported", F.lit(True))
    made = commands.near_events(items)
    return made.select("sourceEntryId", "type", "mediaId", "reason", F.array_join("candidateMediaIds", ",").alias("candidates"))


@query("""
    WITH p AS (SELECT quarantineId, any_value(candidateMediaIds) AS ids, any_value(sourceEntryId) AS entry FROM (SELECT DISTINCT quarantineId, candidateMediaIds, sourceEntryId FROM quarantine_item WHERE status = 'pending') GROUP BY 1 HAVING count(*) = 1),
    c AS (SELECT quarantineId, status, coalesce(acceptedMediaId, '') AS media, rejectedReason AS reason, resolvedAt AS t FROM quarantine_item WHERE status <> 'pending'),
    f AS (SELECT quarantineId, min(struct_pack(t := t, action := CASE status WHEN 'accepted' THEN 'accept' ELSE 'reject' END, media := media, reason := reason)) AS r FROM c GROUP BY 1),
    j AS (SELECT f.quarantineId, p.entry, r, CASE WHEN p.quarantineId IS NULL THEN 'not_found' WHEN r.action = 'accept' AND NOT coalesce(list_contains(p.ids, r.media), false) THEN 'not_a_candidate' END AS error FROM f LEFT JOIN p USING (quarantineId))
    SELECT quarantineId AS "quarantineId", entry AS "sourceEntryId", CASE WHEN error IS NULL THEN CASE r.action WHEN 'accept' THEN 'QUARANTINE_ACCEPTED' ELSE 'QUARANTINE_REJECTED' END END AS type, CASE WHEN error IS NULL AND r.action = 'accept' THEN r.media END AS "mediaId",
           NULL AS level, CASE WHEN error IS NULL AND r.action = 'reject' THEN r.reason END AS reason, error FROM j
    UNION ALL SELECT quarantineId, entry, 'DUPLICATE_LINK_CREATED', r.media, 'probable', 'quarantine-accepted', NULL FROM j WHERE error IS NULL AND r.action = 'accept'
""")
def review_emitted(spark, folder):
    """Events of the decisions in quarantine_item on its pending items."""
    q = table(spark, folder, "quarantine_item")
    action = F.when(F.col("status") == "accepted", "accept").otherwise("reject")
    decisions = q.where("status <> 'pending'").select("quarantineId", action.alias("action"), F.coalesce("acceptedMediaId", F.lit("")).alias("mediaId"), F.col("rejectedReason").alias("reason"), F.col("resolvedAt").alias("at"))
    items = q.where("status = 'pending'").select("quarantineId", "candidateMediaIds", "sourceEntryId").distinct()
    single = items.groupBy("quarantineId").agg(F.first("candidateMediaIds").alias("candidateMediaIds"), F.first("sourceEntryId").alias("sourceEntryId"), F.count("*").alias("n")).where("n = 1")
    made = commands.review_events(single.withColumn("status", F.lit("pending")), decisions)
    return made.select("quarantineId", "sourceEntryId", "type", "mediaId", "level", "reason", "error")


@query("""
    WITH a AS (SELECT quarantineId AS id, any_value(candidateMediaIds) AS ids FROM (SELECT DISTINCT quarantineId, candidateMediaIds FROM quarantine_item) GROUP BY 1 HAVING count(*) = 1),
    x AS (SELECT id, trim(m, ' ' || chr(9)) AS m FROM (SELECT id, unnest(ids) AS m FROM a)),
    known AS (SELECT DISTINCT mediaId FROM media WHERE mediaId IS NOT NULL),
    n AS (SELECT id, count(DISTINCT m) FILTER (m <> '') AS members, count(*) FILTER (m <> '' AND m NOT IN (SELECT mediaId FROM known)) AS gaps FROM x GROUP BY 1),
    c AS (SELECT id, coalesce(members, 0) AS members, coalesce(gaps, 0) AS gaps, CASE WHEN id LIKE '%0' THEN 'delete' WHEN id LIKE '%1' OR id LIKE '%2' THEN 'patch' ELSE 'create' END AS command, id LIKE '%2' AS blank, id LIKE '%3' AS nameless FROM a LEFT JOIN n USING (id))
    SELECT id, CASE WHEN command = 'delete' THEN 'ALBUM_REMOVED' WHEN command = 'patch' AND NOT blank THEN 'ALBUM_UPDATED' WHEN command = 'create' AND NOT nameless AND gaps = 0 THEN 'ALBUM_CREATED' END AS type,
           CASE WHEN command = 'patch' AND blank THEN 'album_patch_empty' WHEN command = 'create' AND nameless THEN 'album_name_required' WHEN command = 'create' AND gaps > 0 THEN 'album_media_not_found' END AS error,
           CASE WHEN command = 'patch' AND NOT blank THEN 1 WHEN command = 'create' AND NOT nameless AND gaps = 0 THEN members END AS members
    FROM c
""")
def album_commands(spark, folder):
    """Albums of candidate lists created, renamed and removed, by the last digit of the list's id."""
    q = table(spark, folder, "quarantine_item").select("quarantineId", "candidateMediaIds").distinct()
    one = q.groupBy("quarantineId").agg(F.first("candidateMediaIds").alias("ids"), F.count("*").alias("n")).where("n = 1")
    id_ = F.col("quarantineId")
    command = F.when(id_.endswith("0"), "delete").when(id_.endswith("1") | id_.endswith("2"), "patch").otherwise("create")
    name = F.when(id_.endswith("1"), F.lit(" renamed ")).when(id_.endswith("2"), None).when(id_.endswith("3"), F.lit("  ")).otherwise(F.lit("new"))
    asked = one.select(command.alias("command"), F.when(command != "create", id_).alias("albumId"), name.alias("name"), F.when(command == "create", F.coalesce("ids", F.array().cast("array<string>"))).alias("mediaIds"), id_.alias("at"))
    albums = one.select(id_.alias("albumId"), F.lit("old").alias("name"), F.array(F.lit("kept")).alias("mediaIds"), F.lit("then").alias("createdAt"))
    media = media_rows(spark, folder).unionByName(spark.createDataFrame([("kept", None, None, None)], "mediaId string, sha256 string, size bigint, sourceEntryId string"))
    made = commands.album_events(asked, albums, media)
    back = asked.where("command = 'create'").select(S.minted("alb", F.col("at")).alias("albumId"), F.col("at").alias("made"))
    rows = made.join(back, "albumId", "left")
    return rows.select(F.coalesce("made", "albumId").alias("id"), "type", "error", F.size("mediaIds").cast("bigint").alias("members"))


@query("""
    WITH s AS (SELECT sourceId AS id, min(struct_pack(p := path, r := recursive, a := includeArchives)) AS r FROM media_source GROUP BY 1),
    c AS (SELECT id, r.p AS path, r.r AS recursive, r.a AS archives, CASE WHEN id LIKE '%0' THEN 'delete' WHEN id LIKE '%1' OR id LIKE '%2' OR id LIKE '%3' THEN 'patch' ELSE 'create' END AS command FROM s)
    SELECT id, CASE command WHEN 'delete' THEN 'SOURCE_REMOVED' WHEN 'patch' THEN CASE WHEN id NOT LIKE '%3' THEN 'SOURCE_UPDATED' END ELSE 'SOURCE_CREATED' END AS type,
           CASE command WHEN 'patch' THEN CASE WHEN id NOT LIKE '%3' THEN recursive END WHEN 'create' THEN true END AS recursive, CASE WHEN command = 'patch' AND id LIKE '%3' THEN 'source_not_found' END AS error FROM c
""")
def source_commands(spark, folder):
    """Sources created with defaults, patched and removed, by the last digit of their id; a patch of an unknown one is refused."""
    rows = table(spark, folder, "media_source").groupBy("sourceId").agg(F.min(F.struct("path", "recursive", "includeArchives")).alias("r")).select("sourceId", "r.*")
    sources = rows.withColumn("excludeGlobs", F.array().cast("array<string>")).withColumn("createdAt", F.col("sourceId"))
    id_ = F.col("sourceId")
    command = F.when(id_.endswith("0"), "delete").when(id_.rlike("[123]$"), "patch").otherwise("create")
    target = F.when(id_.endswith("3"), F.concat(id_, F.lit("-unknown"))).when(command != "create", id_)
    null = F.lit(None).cast("boolean")
    asked = rows.select(command.alias("command"), target.alias("sourceId"), F.when(command == "create", F.col("path")).alias("path"), null.alias("recursive"), null.alias("includeArchives"), F.lit(None).cast("array<string>").alias("excludeGlobs"), id_.alias("at"))
    made = commands.source_events(asked, sources)
    back = asked.where("command = 'create'").select(S.minted("src", F.col("at")).alias("sourceId"), F.col("at").alias("made"))
    shown = made.join(back, "sourceId", "left")
    return shown.select(F.coalesce("made", F.regexp_replace("sourceId", "-unknown$", "")).alias("id"), "type", "recursive", "error")


# Signatures, filters


_KEY = b"test-secret".ljust(64, b"\0")
_PADS = ["".join(f"\\x{b ^ pad:02x}" for b in _KEY) for pad in (0x36, 0x5C)]


@query(f"""
    WITH m AS (SELECT DISTINCT seq, '{{"event":{{"eventId":"' || event.eventId || '","type":"' || event.type || '"}},"seq":' || CAST(seq AS VARCHAR) || '}}' AS t FROM wal_record)
    SELECT seq, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(t)))) AS mac FROM m
""")
def log_macs(spark, folder):
    """HMACs of records of position, id and type, put into canonical form from another order of keys and with their hash."""
    rows = table(spark, folder, "wal_record").select("seq", "event.eventId", "event.type").distinct()
    line = F.to_json(F.struct(F.col("seq"), F.struct("type", "eventId").alias("event"), F.lit("left out").alias("hash")))
    return rows.select("seq", log.hmac_sha256(log._unsigned(line), b"test-secret").alias("mac"))


def _filters_sql() -> str:
    e, q, j, s, li = (f"({ORACLES[n]})" for n in ("view_entries", "view_quarantine", "view_jobs", "view_sources", "view_links"))
    return f"""
        SELECT 'entries by source' AS filter, "sourceEntryId" AS id FROM {e} WHERE "sourceId" = (SELECT min("sourceId") FROM {e})
        UNION ALL SELECT 'pending', "quarantineId" FROM {q} WHERE status = 'pending'
        UNION ALL SELECT 'runnable', "jobId" FROM {j} WHERE status IN ('queued', 'running')
        UNION ALL SELECT 'allowed', "sourceId" FROM {s} WHERE path = (SELECT min(path) FROM {s}) OR starts_with(path, (SELECT min(path) FROM {s}) || '/')
        UNION ALL SELECT 'strong links', "mediaId" || '>' || "sourceEntryId" FROM {li} WHERE level = 'strong' AND "mediaId" IS NOT NULL AND "sourceEntryId" IS NOT NULL
        UNION ALL SELECT 'links of one media', coalesce("sourceEntryId", '') || '>' || coalesce(level, '') FROM {li} WHERE "mediaId" = (SELECT min("mediaId") FROM {li})
        UNION ALL SELECT 'not active', "jobId" FROM {j} j WHERE NOT EXISTS (SELECT 1 FROM {j} a WHERE a.kind = j.kind AND a.status IN ('queued', 'running'))
    """


@query(_filters_sql())
def catalog_filters(spark, folder):
    """The catalog's filters by source, status, root, level, media and active job, over the views of all events."""
    work = Workspace(spark, "filters")
    everything = work.save(all_events(spark, folder), "events")
    c = Catalog(views.domain_views(everything), views.jobs(everything))
    source = c.tables["sourceEntry"].agg(F.min("sourceId")).head()[0]
    root = c.tables["source"].agg(F.min("path")).head()[0]
    media = c.tables["duplicateLink"].agg(F.min("mediaId")).head()[0]
    pair = F.concat_ws(">", F.coalesce("sourceEntryId", F.lit("")), F.coalesce("level", F.lit("")))
    strong = c.duplicate_links("strong").where("mediaId is not null and sourceEntryId is not null")
    requests = c.jobs.select("jobId", "kind", F.lit(None).cast("string").alias("payload"))
    rows = {
        "entries by source": c.entries(source).select(F.col("sourceEntryId").alias("id")), "pending": c.quarantine("pending").select(F.col("quarantineId").alias("id")),
        "runnable": c.runnable_jobs().select(F.col("jobId").alias("id")), "allowed": c.sources([root] if root else []).select(F.col("sourceId").alias("id")),
        "strong links": strong.select(F.concat_ws(">", "mediaId", "sourceEntryId").alias("id")), "links of one media": c.duplicate_links(media_id=media).select(pair.alias("id")),
        "not active": pipeline.without_active(requests, c.jobs.withColumn("payload", F.lit(None).cast("string"))).select(F.col("jobId").alias("id")),
    }
    out = None
    for name, found in rows.items():
        one = found.select(F.lit(name).alias("filter"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_HEAD_SQL = "CASE WHEN len(string_split(fp, ':')) = 3 AND try_cast(split_part(fp, ':', 1) AS BIGINT) IS NOT NULL AND split_part(fp, ':', 3) <> '' THEN split_part(fp, ':', 1) || ':' || split_part(fp, ':', 3) END"


@query(f"""
    WITH {_entries_sql('e')}, k AS (SELECT sourceEntryId AS id, sourceId || ':file:' || coalesce(path, '') AS key, {_HEAD_SQL.replace('fp', 'fingerprint')} AS head FROM e WHERE path IS NOT NULL)
    SELECT 'key' AS filter, id FROM k WHERE key = (SELECT min(key) FROM k) UNION ALL SELECT 'head', id FROM k WHERE head = (SELECT min(head) FROM k)
    UNION ALL SELECT 'hash prefix', mediaId FROM (SELECT mediaId, lower(trim(try_cast(raw AS JSON)->>'$.perceptualHash')) AS h FROM (SELECT mediaId, arg_max(raw, extractedAt) AS raw FROM media_metadata GROUP BY 1))
              WHERE regexp_full_match(h, '[0-9a-f]{{16}}') AND left(h, 4) = (SELECT left(min(h), 4) FROM (SELECT lower(trim(try_cast(raw AS JSON)->>'$.perceptualHash')) AS h FROM (SELECT arg_max(struct_pack(raw := raw), extractedAt).raw AS raw FROM media_metadata GROUP BY mediaId)) WHERE regexp_full_match(h, '[0-9a-f]{{16}}'))
""")
def catalog_lookups(spark, folder):
    """Entries by natural key and by head, media by hash prefix, for the least of each."""
    entries = latest_entries(spark, folder, "archivePath", "innerPath").where("path is not null")
    meta = current(spark, folder).select("mediaId", F.try_parse_json("raw").alias("raw"))
    c = Catalog({"sourceEntry": entries, "metadata": meta})
    key = entries.agg(F.min(S.natural_key(*(F.col(x) for x in ("sourceId", "path", "archivePath", "innerPath"))))).head()[0]
    head = entries.agg(F.min(S.head_key("fingerprint"))).head()[0]
    phash = meta.agg(F.min(S.perceptual_hash(F.try_variant_get("raw", "$.perceptualHash", "string")))).head()[0]
    found = c.entry_by_key(key).select(F.lit("key").alias("filter"), F.col("sourceEntryId").alias("id"))
    found = found.unionByName(c.entries_by_head(head).select(F.lit("head").alias("filter"), F.col("sourceEntryId").alias("id")))
    return found.unionByName(c.media_by_hash_prefix(phash).select(F.lit("hash prefix").alias("filter"), F.col("mediaId").alias("id")))


@query("SELECT key, CASE WHEN raw = 'whole' THEN printf('%.1f', floor(lat * 10) / 10) || ':' || printf('%.1f', floor(lon * 10) / 10) WHEN raw = 'own' THEN 'tile ' || CAST(key AS VARCHAR) END AS tile, CASE WHEN raw <> 'cut' THEN '{\"a\":' || CAST(key AS VARCHAR) || ',\"b\":[1,\"x\"]}' END AS canonical FROM (SELECT c_custkey AS key, c_acctbal / 100 AS lat, c_acctbal / 77 AS lon, CASE c_custkey % 3 WHEN 0 THEN 'whole' WHEN 1 THEN 'own' ELSE 'cut' END AS raw FROM customer)")
def raw_tiles(spark, folder):
    """Tiles from raw metadata by coordinates, as numbers and texts, or by a tile of its own, and canonical JSON; a third is cut off."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_acctbal") / 77).alias("lon"))
    kind = F.col("key") % 3
    whole = F.to_json(F.struct(F.col("lat").alias("GPSLatitude"), F.col("lon").cast("string").alias("lon")))
    own = F.to_json(F.struct(F.lit(1).alias("lat"), F.lit(1).alias("lon"), F.concat(F.lit(" Tile "), F.col("key").cast("string")).alias("gpsTile")))
    text = F.when(kind == 0, whole).when(kind == 1, own).otherwise("{cut")
    mixed = F.when(kind < 2, F.concat(F.lit('{ "b" : [1, "x"], "a":'), F.col("key").cast("string"), F.lit(".0}"))).otherwise("{cut")
    return rows.select("key", S.gps_tile_of_raw(F.try_parse_json(text)).alias("tile"), S.canonical_json(mixed).alias("canonical"))


# Log and snapshot round trips, jobs and pages


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS seq, 'nation ' || n_name AS \"eventId\", true AS version_ok, true AS seq_ok, true AS prev_ok, true AS hash_ok FROM nation")
def log_round_trip(spark, folder):
    """The nations appended to a log in segments of a few records, read back and checked with their hashes."""
    work = Workspace(spark, "log")
    rows = table(spark, folder, "nation").orderBy("n_nationkey").collect()  # a list of the world's nations
    made = [{"eventId": f"nation {r['n_name']}", "type": "NATION_SEEN", "createdAt": 1.5, "payload": {"key": r["n_nationkey"], "region": r["n_regionkey"]}} for r in rows]
    log.append(spark, work.path("wal"), made[:10], b"test-secret", 10.0, max_bytes=600)
    log.append(spark, work.path("wal"), made[10:], b"test-secret", 11.0, max_bytes=600)
    held = log.verify(log.read_log(spark, work.path("wal")), b"test-secret")
    return held.select("seq", "event.eventId").join(log.checks(held, b"test-secret"), "seq")


@query(ORACLES["view_entries"])
def snapshot_round_trip(spark, folder):
    """Entries written in a snapshot beside an older one, found by the pointer and read back; older ones are pruned."""
    root = Workspace(spark, "snapshots").path("all")
    tables = views.domain_views(events(spark, folder))
    log.write_snapshot(spark, root, {"source": tables["source"]}, 1, 1000, "a")
    log.write_snapshot(spark, root, {"source": tables["source"], "sourceEntry": tables["sourceEntry"]}, 2, 2000, "b")
    log.prune_snapshots(spark, root, 1)
    return log.read_snapshot(spark, root, "sourceEntry", "sourceEntryId string, sourceId string, path string, state string, pos bigint")


@query(f"""
    WITH {EVENTS_SQL}, j AS (SELECT p->>'$.jobId' AS id, seq, type, made, p FROM ev WHERE type LIKE 'JOB_%'),
    r AS (SELECT id, arg_min(made, seq) FILTER (type = 'JOB_ENQUEUED') AS created, arg_max(made, seq) FILTER (type <> 'JOB_ENQUEUED') AS later,
                 arg_max(struct_pack(e := CASE WHEN type <> 'JOB_STARTED' THEN p->>'$.error' END), seq) FILTER (type IN ('JOB_STARTED', 'JOB_FAILED', 'JOB_RETRY_SCHEDULED')) AS err, bool_or(type = 'JOB_ENQUEUED') AS known FROM j GROUP BY 1)
    SELECT id AS "jobId", created AS "createdAt", coalesce(later, created) AS "updatedAt", err.e AS "lastError" FROM r WHERE known
""")
def view_jobs_times(spark, folder):
    return views.jobs(events(spark, folder)).select("jobId", "createdAt", "updatedAt", "lastError")


@query(f"SELECT CASE status WHEN 'running' THEN 'queued' ELSE status END AS status, count(*) AS n, count(*) FILTER (status = 'running') AS resumed FROM ({ORACLES['view_jobs']}) GROUP BY 1")
def jobs_resumed(spark, folder):
    """Jobs by status after a restart queues running ones again, and how many those are."""
    jobs = views.jobs(events(spark, folder))
    reset = views.reset_running(jobs.withColumn("was", F.col("status")))
    return reset.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("was") == "running").alias("resumed"))


@query("""
    WITH s AS (SELECT event_type AS kind, epoch_us(ts) AS t, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS change FROM events),
    g AS (SELECT kind, t, change, sum(change) AS step FROM s GROUP BY 1, 2, 3),
    w AS (SELECT kind, sum(step) OVER (PARTITION BY kind ORDER BY t, change ROWS UNBOUNDED PRECEDING) AS now FROM g)
    SELECT kind, CAST(max(now) AS BIGINT) AS most FROM w GROUP BY 1
""")
def jobs_at_once(spark, folder):
    """The most that ran at once by kind, in a trace of starts and ends."""
    e = table(spark, folder, "events")
    trace = e.select(F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("change"))
    return pipeline.running_at_once(trace)


@query("""
    SELECT o_orderkey, CASE WHEN t > 0 THEN CASE WHEN o >= t THEN (t - 1) // l * l ELSE o END ELSE 0 END AS "start"
    FROM (SELECT o_orderkey, o_custkey % 50 AS t, 1 + o_orderkey % 9 AS l, o_orderkey % 60 AS o FROM orders)
""")
def page_clamp(spark, folder):
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey % 50 as t", "1 + o_orderkey % 9 as l", "o_orderkey % 60 as o")
    return rows.select("o_orderkey", search.last_page_offset(F.col("t"), F.col("l"), F.col("o")).alias("start"))


@query(f"""
    WITH {CURRENT_SQL}, {MEDIA_SQL}, {_entries_sql('e')}, x AS (SELECT m.mediaId, c.mimeType AS own, e.path FROM m LEFT JOIN current c USING (mediaId) LEFT JOIN e USING (sourceEntryId))
    SELECT mediaId AS "mediaId", coalesce(own, {_case(S.SERVED_MIME, _EXT)}, 'application/octet-stream') AS "mimeType" FROM x
""")
def served_types(spark, folder):
    return pipeline.served_types(media_rows(spark, folder), current(spark, folder), latest_entries(spark, folder))


@query("""
    SELECT DISTINCT mediaId AS "mediaId", takenAt AS "takenAt", 'derived/' || left(mediaId, 2) || '/' || mediaId || '/' || kind || '.jpg' AS path,
           CASE WHEN regexp_full_match(trim(left(takenAt, 10)), '\\d{4}-\\d{2}-\\d{2}') THEN trim(left(takenAt, 10)) END AS day,
           CASE WHEN regexp_full_match(takenAt, '\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN epoch_ms(try_strptime(takenAt, '%Y:%m:%d %H:%M:%S')) END AS ms
    FROM media_metadata WHERE mediaId IS NOT NULL
""")
def media_scalars(spark, folder):
    """Paths of derived files, days by form and camera times of all metadata rows."""
    m = table(spark, folder, "media_metadata").where("mediaId is not null").select("mediaId", "takenAt", "kind").distinct()
    camera = F.col("takenAt").rlike("^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}\\z")
    return m.select("mediaId", "takenAt", S.derived_path(F.col("mediaId"), F.col("kind")).alias("path"), S.valid_day(F.substring("takenAt", 1, 10)).alias("day"), F.when(camera, S.exif_ms("takenAt")).alias("ms")).distinct()
