"""Faceted search over a catalog view: filters, order, offset and keyset pages.

The view has one row per indexed media id: mediaId, present (whether a media row exists), kind,
mimeType, sourceId, levels, cameraModel, takenAt, takenDay, gpsTile, sha256. Filters are plain
predicates that reach the scan where the view is stored; a page is a top-k, not a full sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions import scalars as S
from skeinlake.plans.staging import Workspace

#: Kinds of media, and sort orders.
KINDS = ("photo", "video", "unknown")
SORTS = ("mediaId_asc", "takenAt_desc")
MAX_LIMIT, DEFAULT_LIMIT = 500, 100


@dataclass(frozen=True)
class SearchRequest:
    kind: str | None = None
    mime_type: str | None = None
    source_id: str | None = None
    duplicate_level: str | None = None
    camera_model: str | None = None
    taken_day: str | None = None
    gps_tile: str | None = None
    sha256_prefix: str | None = None
    sort: str = "mediaId_asc"
    limit: int | str | None = None
    offset: int | str | None = None
    cursor: str | None = None

    def has_filters(self) -> bool:
        return any((self.kind, self.mime_type, self.source_id, self.duplicate_level, self.camera_model, self.taken_day, self.gps_tile, self.sha256_prefix))

    def page(self) -> tuple[int, int]:
        """Limit (1 to 500, else 100) and offset (0 unless positive)."""
        return min(_whole(self.limit) or DEFAULT_LIMIT, MAX_LIMIT), _whole(self.offset) or 0

    def errors(self) -> list[str]:
        """The codes with which the query endpoint rejects a request, in its order; the endpoint names the first.

        The search itself is more lenient.
        """
        blank = lambda text: text is not None and not text.strip()
        checks = [
            ("invalid_sort", self.sort not in SORTS),
            ("invalid_kind_filter", self.kind is not None and self.kind not in KINDS),
            ("invalid_mime_type_filter", blank(self.mime_type)),
            ("invalid_source_id_filter", blank(self.source_id)),
            ("invalid_duplicate_level_filter", self.duplicate_level is not None and self.duplicate_level not in S.LEVELS),
            ("invalid_camera_model_filter", blank(self.camera_model)),
            ("invalid_taken_day_filter", self.taken_day is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", self.taken_day.strip())),
            ("invalid_gps_tile_filter", blank(self.gps_tile)),
            ("invalid_sha256_prefix_filter", self.sha256_prefix is not None and not re.fullmatch(r"[0-9a-fA-F]{2,64}", self.sha256_prefix.strip())),
            ("search_filter_required", not self.has_filters()),
            ("invalid_cursor", blank(self.cursor)),
            ("invalid_pagination_params", bool(self.cursor and self.cursor.strip()) and self.offset is not None),
        ]
        return [code for code, fails in checks if fails]

    def filters(self) -> dict[str, str | None]:
        """The filters as the response repeats them."""
        trimmed = lambda text: (text or "").strip() or None
        return {
            "kind": self.kind, "mimeType": self.mime_type, "sourceId": self.source_id, "duplicateLevel": self.duplicate_level, "cameraModel": trimmed(self.camera_model),
            "takenDay": trimmed(self.taken_day), "gpsTile": trimmed(self.gps_tile), "sha256Prefix": (trimmed(self.sha256_prefix) or "").lower() or None,
        }


def _whole(value: int | str | None) -> int | None:
    """A leading positive whole number, as lenient number parsing reads it."""
    m = re.match(r"\s*\+?(\d+)", str(value)) if value is not None else None
    return int(m[1]) if m and int(m[1]) > 0 else None


def catalog_view(media: DataFrame, metadata: DataFrame, entries: DataFrame, links: DataFrame) -> DataFrame:
    """The search view of current tables with unique keys.

    ``metadata`` has takenAt in epoch ms and raw as JSON text. Ids that only metadata or links name
    are in the view with ``present`` false: they count in totals but have no media row.
    """
    by_entry = media.select("mediaId", "sourceEntryId", "sha256")
    source = by_entry.join(entries.select("sourceEntryId", "sourceId"), "sourceEntryId", "left")
    direct = links.select("mediaId", "level")
    through = links.select("sourceEntryId", "level").join(by_entry.select("sourceEntryId", "mediaId"), "sourceEntryId").select("mediaId", "level")
    levels = direct.unionByName(through).where("mediaId is not null").groupBy("mediaId").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    facts = metadata.select(
        "mediaId",
        "kind",
        S.normalized("mimeType").alias("mimeType"),
        S.normalized("cameraModel").alias("cameraModel"),
        "takenAt",
        S.taken_day("takenAt").alias("takenDay"),
        S.gps_tile_of_raw(F.try_parse_json("raw")).alias("gpsTile"),
    )
    rows = source.select("mediaId", "sourceId", S.sha256_hex("sha256").alias("sha256"), F.lit(True).alias("present"))
    view = rows.join(facts, "mediaId", "full_outer").join(levels, "mediaId", "full_outer")
    return view.withColumn("present", F.coalesce("present", F.lit(False)))


#: Rows of a search view per file and task.
ROWS_PER_PART = 1_000_000


def stored(view: DataFrame, work: Workspace, name: str = "view") -> DataFrame:
    """The view written in ranges of mediaId of about ``ROWS_PER_PART`` rows, so that a page reads few, sorted files."""
    parts = max(1, -(-view.count() // ROWS_PER_PART))
    ranges = view.coalesce(1) if parts == 1 else view.repartitionByRange(parts, "mediaId")
    return work.save(ranges.sortWithinPartitions("mediaId"), name)


def predicate(request: SearchRequest) -> Column:
    """All filters of a request; blank filters are ignored, malformed days and prefixes match nothing."""
    test = F.lit(True)
    if request.kind:
        test &= F.col("kind") == request.kind
    if request.mime_type and (mime := request.mime_type.strip().lower()):
        test &= F.col("mimeType") == mime
    if request.source_id:
        test &= F.col("sourceId") == request.source_id
    if request.duplicate_level:
        test &= F.array_contains("levels", request.duplicate_level)
    if request.camera_model and (camera := request.camera_model.strip().lower()):
        test &= F.col("cameraModel") == camera
    if request.taken_day:
        day = request.taken_day.strip()
        test &= (F.col("takenDay") == day) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) else F.lit(False)
    if request.gps_tile and (tile := request.gps_tile.strip().lower()):
        test &= F.col("gpsTile") == tile
    if request.sha256_prefix:
        prefix = request.sha256_prefix.strip().lower()
        test &= F.col("sha256").startswith(prefix) if re.fullmatch(r"[0-9a-f]{2,64}", prefix) else F.lit(False)
    return test


def matching(view: DataFrame, request: SearchRequest) -> DataFrame:
    """Rows a request matches; without filters, all media rows."""
    return view.where(predicate(request)) if request.has_filters() else view.where("present")


def order(sort: str) -> list[Column]:
    if sort == "takenAt_desc":
        return [F.col("takenAt").desc_nulls_last(), F.col("mediaId").asc()]
    return [F.col("mediaId").asc()]


def after(matched: DataFrame, view: DataFrame, cursor: str, sort: str) -> DataFrame:
    """Rows after a cursor. In time order a cursor that is unknown, or has neither a time nor a place in the results, starts again."""
    if sort == "mediaId_asc":
        return matched.where(F.col("mediaId") > cursor)
    row = view.where(F.col("mediaId") == cursor).select("takenAt").head()
    taken = row["takenAt"] if row else None
    if taken is not None:
        later = (F.col("takenAt") < taken) | F.col("takenAt").isNull()
        return matched.where(later | ((F.col("takenAt") == taken) & (F.col("mediaId") > cursor)))
    if row is None or matched.where(F.col("mediaId") == cursor).isEmpty():
        return matched
    return matched.where(F.col("takenAt").isNull() & (F.col("mediaId") > cursor))


def page_rows(view: DataFrame, request: SearchRequest) -> DataFrame:
    """Rows of the requested page, also of ids that have no media row (``present`` false)."""
    limit, offset = request.page()
    rows = matching(view, request)
    if request.cursor:
        rows, offset = after(rows, view, request.cursor, request.sort), 0
    ordered = rows.orderBy(*order(request.sort))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page(view: DataFrame, request: SearchRequest) -> DataFrame:
    """Rows of the requested page that have a media row."""
    return page_rows(view, request).where("present")


def total(view: DataFrame, request: SearchRequest) -> DataFrame:
    """total: what a request matches before paging."""
    return matching(view, request).agg(F.count("*").alias("total"))


def next_cursor(ids: list[str], request: SearchRequest) -> str | None:
    """The cursor of the page after ``ids`` (all of the page, media row or not): its last id if it is full, none in offset mode."""
    limit, _ = request.page()
    return ids[-1] if request.offset is None and len(ids) == limit and ids else None


def respond(view: DataFrame, request: SearchRequest) -> dict:
    """The endpoint's response to a request that has no errors: at most a page of rows is collected."""
    limit, offset = request.page()
    rows = page_rows(view, request).collect()
    return {
        "media": [r for r in rows if r["present"]], "total": total(view, request).head()["total"], "limit": limit, "offset": offset, "sort": request.sort,
        "cursor": request.cursor, "nextCursor": next_cursor([r["mediaId"] for r in rows], request), "filters": request.filters(),
    }


def page_stats(totals: DataFrame) -> DataFrame:
    """Adds pageCount, pageNumber, hasPrev, hasNext to columns total, limit, offset; limits below 1 count as 1, negatives as 0."""
    limit = F.greatest(F.coalesce(F.col("limit"), F.lit(1)), F.lit(1)).cast("bigint")
    count = F.greatest(F.coalesce(F.col("total"), F.lit(0)), F.lit(0)).cast("bigint")
    start = F.greatest(F.coalesce(F.col("offset"), F.lit(0)), F.lit(0)).cast("bigint")
    pages = F.greatest(F.ceil(count / limit), F.lit(1)).cast("bigint")
    number = F.least(F.floor(start / limit) + 1, pages).cast("bigint")
    return totals.withColumns({"pageCount": pages, "pageNumber": number, "hasPrev": start > 0, "hasNext": start + limit < count})


def last_page_offset(total: Column, limit: Column, offset: Column) -> Column:
    """The offset, or the start of the last page if it lies beyond the total."""
    return F.when((offset >= total) & (total > 0), F.floor((total - 1) / limit) * limit).otherwise(F.when(total > 0, offset).otherwise(0)).cast("bigint")


def facet_counts(view: DataFrame, facet: str) -> DataFrame:
    """value, n of a facet; levels count once for each media."""
    rows = view.select(F.explode("levels").alias("value")) if facet == "levels" else view.select(F.col(facet).alias("value"))
    return rows.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def pick(view: DataFrame, chosen: DataFrame, text: str, limit: int) -> DataFrame:
    """The first ``limit`` media by id that aren't chosen yet and whose id or digest contains a text."""
    low = text.strip().lower()
    rows = view.where("present").join(chosen.select("mediaId"), "mediaId", "left_anti")
    if low:
        rows = rows.where(F.lower("mediaId").contains(low) | F.lower("sha256").contains(low))
    return rows.orderBy("mediaId").limit(limit)
