"""Queries over the data-processing operators of the core: p1, p3 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.operators import change_feed, instants, snapshot_diff
from skeinlake.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_diff.entry_changes(table(spark, folder, "entry_snapshot"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    metadata = table(spark, folder, "media_metadata").select("mediaId", "takenAt", "tzName", "cameraModel", "extractedAt")
    read = instants.normalise(metadata, "takenAt", "tzName", "cameraModel", not_after="extractedAt")
    return read.where("instantMs is not null").select("mediaId", F.col("instantMs").alias("takenAtMs")).distinct()


def p3_slashed(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as slashed texts of seven sources, of which three write the day first, three the month, and one only dates that may be either.

    The mixture of each source settles which it is; where nothing in the source decides, dates
    are ambiguous unless both readings are the same.
    """
    o = table(spark, folder, "orders")
    source = (F.col("o_custkey") % 7).alias("source")
    day, month = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    day = F.when(F.col("source") == 6, (day - 1) % 12 + 1).otherwise(day)
    dated = o.select("o_orderkey", "o_orderdate", source)
    text = F.when(F.col("source") < 3, F.format_string("%02d/%02d/%04d 10:00:00", day, month, F.year("o_orderdate")))
    text = text.otherwise(F.format_string("%02d/%02d/%04d 10:00:00", month, day, F.year("o_orderdate")))
    texts = dated.select("o_orderkey", "source", text.alias("text"))
    read = instants.normalise(texts.withColumn("tz", F.lit("UTC")), "text", "tz", "source")
    return read.select("o_orderkey", "instantMs", "status")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = change_feed.replay(table(spark, folder, "wal_record"))
    return entries.select("sourceEntryId", "fingerprint", "state")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_slashed": p3_slashed, "p5_found": p5_found}

_SPACES = f"'{instants.SPACES}{instants.DASHES}', '{' ' * len(instants.SPACES)}{'-' * len(instants.DASHES)}'"
_CLOCK = "(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d+))?)?\\s*([ap]m\\b)?(?:\\s*(z|(?:utc|gmt)?\\s*[+-]\\d{1,2}:?\\d{0,2}|[a-z]+(?:/[a-z0-9_+-]+)*))?(?:\\s*\\[([^\\]]+)\\])?"
_NAMES = ["p1", "p2", "p3", "h", "mi", "s", "f", "ap", "z", "zz"]
#: Pattern of the fields, their names, and year, month, day in terms of them.
_SHAPES = [
    (f"^(\\d{{4}})[-:/](\\d{{1,2}})[-:/](\\d{{1,2}})(?:t|\\s+){_CLOCK}$", _NAMES, "e.p1", "e.p2", "e.p3"),
    (f"^(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})[t, ]+{_CLOCK}$", _NAMES, "e.p3", "e.p2", "e.p1"),
    (f"^(?:[a-z]+,?\\s+)?(\\d{{1,2}})[ -]([a-z]{{3}})[a-z]*\\.?[ -](\\d{{4}})[, ]+{_CLOCK}$", _NAMES, "e.p3", "e.p2", "e.p1"),
    (f"^([a-z]{{3}})[a-z]*\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}}),?\\s+{_CLOCK}$", _NAMES, "e.p3", "e.p1", "e.p2"),
    ("^(\\d{4})(\\d{2})(\\d{2})(\\d{2})(\\d{2})(\\d{2})?(\\d{1,9})?$", _NAMES[:7], "e.p1", "e.p2", "e.p3"),
    ("^(\\d{4})(\\d{2})(\\d{2})t(\\d{2})(\\d{2})(?:(\\d{2})(?:[.,](\\d+))?)?(?:\\s*(z|[+-]\\d{2}:?\\d{0,2}))?$", _NAMES[:7] + ["z"], "e.p1", "e.p2", "e.p3"),
]


def _shape_sql(pattern: str, names: list[str], year: str, month: str, day: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    field = lambda n: f"e.{n}" if n in names else "''"
    number = f"coalesce(try_cast({month} AS INTEGER), list_position({list(instants.MONTHS)}, lower({month})))"
    return f"""SELECT value, tz, {year} AS y, {number} AS mo, {day} AS d, e.h AS h, e.mi AS mi, coalesce(nullif(e.s, ''), '0') AS s, e.f AS f, lower({field('ap')}) AS ap,
        coalesce(nullif(trim({field('z')}), ''), nullif(trim({field('zz')}), ''), tz) AS zone
        FROM (SELECT value, tz, regexp_extract(v, '(?i){pattern}', [{listed}]) AS e FROM v WHERE regexp_matches(v, '(?i){pattern}') AND NOT counts)"""


#: CTEs up to ``instant`` (value, tz, ms): what the values of media_metadata denote by the rules of TESTDATA.md.
INSTANT_SQL = f"""
    raw AS (SELECT DISTINCT takenAt AS value, tzName AS tz0 FROM media_metadata WHERE takenAt IS NOT NULL),
    v AS (SELECT *, coalesce(n BETWEEN 946684800 AND 2082758399 OR n BETWEEN 946684800000 AND 2082758399999 OR n BETWEEN 946684800000000 AND 2082758399999999, false) AS counts
          FROM (SELECT *, CASE WHEN regexp_matches(v, '^\\d{{1,18}}(\\.\\d+)?$') THEN try_cast(split_part(v, '.', 1) AS BIGINT) END AS n
                FROM (SELECT value, tz0, trim(translate(value, {_SPACES})) AS v, coalesce(nullif(trim(tz0), ''), 'UTC') AS tz FROM raw))),
    numbers AS (SELECT value, tz, CASE WHEN n < 2082758400 THEN n * 1000 + try_cast(rpad(left(split_part(v, '.', 2), 3), 3, '0') AS BIGINT) WHEN n < 2082758400000 THEN n ELSE n // 1000 END AS ms FROM v WHERE counts),
    parts AS ({" UNION ALL ".join(_shape_sql(*shape) for shape in _SHAPES)}),
    walls AS (SELECT value, tz, zone, CASE WHEN f = '' THEN 0 ELSE try_cast(rpad(left(f, 3), 3, '0') AS BIGINT) END AS frac,
                     try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', try_cast(y AS INTEGER), coalesce(mo, 0), try_cast(d AS INTEGER),
                                     CASE ap WHEN '' THEN try_cast(h AS INTEGER) WHEN 'pm' THEN try_cast(h AS INTEGER) % 12 + 12 ELSE try_cast(h AS INTEGER) % 12 END, try_cast(mi AS INTEGER), try_cast(s AS INTEGER)) AS TIMESTAMP) AS wall,
                     regexp_extract(zone, '(?i)^(?:utc|gmt)?\\s*([+-])(\\d{{1,2}}):?(\\d{{2}})?$', ['sign', 'h', 'm']) AS o FROM parts),
    placed AS (SELECT *, CASE WHEN o.sign = '' AND NOT lower(zone) IN ('z', 'utc', 'gmt') AND zone IN (SELECT name FROM pg_timezone_names()) THEN timezone(zone, wall) END AS t FROM walls WHERE wall IS NOT NULL),
    instant AS (
        SELECT value, tz, ms FROM numbers
        UNION ALL
        SELECT value, tz, frac + CASE WHEN o.sign <> '' THEN epoch_ms(wall) - CASE o.sign WHEN '-' THEN -1 ELSE 1 END * (try_cast(o.h AS BIGINT) * 60 + try_cast(coalesce(nullif(o.m, ''), '0') AS BIGINT)) * 60000
                    WHEN lower(zone) IN ('z', 'utc', 'gmt') THEN epoch_ms(wall)
                    WHEN timezone(zone, t - INTERVAL 60 MINUTE) = wall THEN epoch_ms(t - INTERVAL 60 MINUTE)
                    WHEN timezone(zone, t - INTERVAL 30 MINUTE) = wall THEN epoch_ms(t - INTERVAL 30 MINUTE) ELSE epoch_ms(t) END
        FROM placed WHERE t IS NOT NULL OR o.sign <> '' OR lower(zone) IN ('z', 'utc', 'gmt'))
"""

ORACLES = {
    "p1_found": """
        WITH latest AS (
            SELECT snapshotNo AS s, sourceEntryId AS id,
                   max(struct_pack(seen := lastSeenAt, m := CAST(floor(mtimeMs) AS BIGINT), st := state, f := lower(fingerprint))) AS v
            FROM entry_snapshot WHERE sourceEntryId IS NOT NULL AND snapshotNo IS NOT NULL GROUP BY 1, 2),
        numbers AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT s FROM latest)),
        paired AS (
            SELECT n.s, l.id, max(CASE WHEN l.s = n.s THEN l.v END) AS now, max(CASE WHEN l.s = n.before THEN l.v END) AS old
            FROM numbers n JOIN latest l ON l.s = n.s OR l.s = n.before WHERE n.before IS NOT NULL GROUP BY 1, 2)
        SELECT CAST(s AS INTEGER) AS "snapshotNo", id AS "sourceEntryId",
               CASE WHEN old IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS "changeKind"
        FROM paired
        WHERE old IS NULL OR now IS NULL OR now.m IS DISTINCT FROM old.m OR now.st IS DISTINCT FROM old.st OR now.f <> old.f
    """,
    "p3_found": f"""
        WITH {INSTANT_SQL}
        SELECT DISTINCT m.mediaId AS "mediaId", i.ms AS "takenAtMs" FROM media_metadata m JOIN instant i ON i.value = m.takenAt AND i.tz = coalesce(nullif(trim(m.tzName), ''), 'UTC') WHERE i.ms IS NOT NULL
    """,
    "p3_slashed": """
        WITH t AS (SELECT o_orderkey, o_custkey % 7 AS source, month(o_orderdate) AS m, year(o_orderdate) AS y,
                          CASE WHEN o_custkey % 7 = 6 THEN (day(o_orderdate) - 1) % 12 + 1 ELSE day(o_orderdate) END AS d FROM orders)
        SELECT o_orderkey, CASE WHEN source < 6 OR d = m THEN epoch_ms(make_timestamp(y, m, d, 10, 0, 0)) END AS "instantMs",
               CASE WHEN source = 6 AND d <> m THEN 'ambiguous' WHEN d > 12 THEN 'single' ELSE 'resolved' END AS status FROM t
    """,
    "p5_found": """
        WITH first_seen AS (
            SELECT event.eventId AS eid, min(seq) AS seq, arg_min(event.type, seq) AS type, arg_min(event.payload, seq) AS p
            FROM wal_record
            WHERE event.type IN ('SOURCE_ENTRY_UPSERTED', 'SOURCE_ENTRY_MARKED_MISSING', 'SOURCE_REMOVED') GROUP BY 1),
        up AS (
            SELECT json_extract_string(p, '$.entry.sourceEntryId') AS id, max(seq) AS u, arg_max(p, seq) AS p
            FROM first_seen WHERE type = 'SOURCE_ENTRY_UPSERTED' GROUP BY 1),
        mark AS (
            SELECT json_extract_string(p, '$.sourceEntryId') AS id, max(seq) AS m
            FROM first_seen WHERE type = 'SOURCE_ENTRY_MARKED_MISSING' GROUP BY 1),
        gone AS (
            SELECT json_extract_string(p, '$.sourceId') AS source, max(seq) AS r FROM first_seen WHERE type = 'SOURCE_REMOVED' GROUP BY 1)
        SELECT up.id AS "sourceEntryId", json_extract_string(up.p, '$.entry.fingerprint') AS fingerprint,
               CASE WHEN mark.m > up.u THEN 'missing' ELSE json_extract_string(up.p, '$.entry.state') END AS state
        FROM up LEFT JOIN mark ON mark.id = up.id
             LEFT JOIN gone ON gone.source = json_extract_string(up.p, '$.entry.sourceId')
        WHERE coalesce(json_extract_string(up.p, '$.entry.state'), '') <> 'deleted' AND (gone.r IS NULL OR gone.r < up.u)
    """,
}
