"""Scalar functions of the catalog as column expressions.

Nulls give null unless said otherwise; texts that don't have the required form give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlake.functions.text import strip

#: File extensions by kind, and MIME types by extension of the metadata step and of file serving.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif", ".tif", ".tiff", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".3gp")
METADATA_MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp",
    ".heic": "image/heic", ".heif": "image/heif", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo",
    ".webm": "video/webm", ".m4v": "video/x-m4v", ".3gp": "video/3gpp",
}
SERVED_MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp",
    ".bmp": "image/bmp", ".svg": "image/svg+xml", ".avif": "image/avif", ".heic": "image/heic", ".heif": "image/heif",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".m4v": "video/x-m4v", ".webm": "video/webm",
}
#: Duplicate levels, and keys of coordinates in the order they are tried.
LEVELS = ("exact", "strong", "probable")
GPS_KEYS = {"lat": ("gpsLatitude", "GPSLatitude", "latitude", "lat"), "lon": ("gpsLongitude", "GPSLongitude", "longitude", "lon")}


def normalized(text: Column | str) -> Column:
    """Trimmed lower case; null if blank."""
    low = F.lower(strip(text))
    return F.when(low != "", low)


def hex_of(text: Column | str, digits: int) -> Column:
    """Trimmed lower case hex of exactly ``digits`` digits."""
    low = F.lower(strip(text))
    return F.when(low.rlike(f"^[0-9a-f]{{{digits}}}\\z"), low)


def sha256_hex(text: Column | str) -> Column:
    return hex_of(text, 64)


def perceptual_hash(text: Column | str) -> Column:
    return hex_of(text, 16)


def code_of_hex(text: Column | str) -> Column:
    """The 64 bits of a valid perceptual hash."""
    return F.conv(perceptual_hash(text), 16, -10).cast("bigint")


def hamming_codes(a: Column, b: Column) -> Column:
    """Differing bits of two codes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two perceptual hashes; null unless both are valid."""
    return F.bit_count(code_of_hex(a).bitwiseXOR(code_of_hex(b)))


def instant_of_ms(ms: Column | str) -> Column:
    """Timestamp of epoch milliseconds; fractions are cut toward zero."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_millis(ms.cast("bigint"))


def taken_day(ms: Column | str) -> Column:
    """UTC day of epoch milliseconds as yyyy-MM-dd, whatever the session's zone."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms.cast("bigint") / 86_400_000).cast("int")), "yyyy-MM-dd")


def valid_day(text: Column | str) -> Column:
    """yyyy-MM-dd by form only; days that don't exist are allowed."""
    trimmed = strip(text)
    return F.when(trimmed.rlike("^\\d{4}-\\d{2}-\\d{2}\\z"), trimmed)


def gps_tile(lat: Column, lon: Column) -> Column:
    """Tile of a tenth of a degree as lat:lon with one decimal."""
    tenth = lambda x: F.floor(x * 10) / 10
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.1f:%.1f", tenth(lat), tenth(lon)))


def finite_number(text: Column | str, blank_is_zero: bool = False) -> Column:
    """A finite number from decimal text or 0x, 0o, 0b digits; ``blank_is_zero`` reads blank text as 0."""
    trimmed = strip(text)
    radix = F.when(trimmed.rlike("(?i)^0x[0-9a-f]{1,15}\\z"), F.conv(F.substring(trimmed, 3, 15), 16, 10))
    radix = radix.when(trimmed.rlike("(?i)^0o[0-7]{1,20}\\z"), F.conv(F.substring(trimmed, 3, 20), 8, 10))
    radix = radix.when(trimmed.rlike("(?i)^0b[01]{1,62}\\z"), F.conv(F.substring(trimmed, 3, 62), 2, 10)).cast("double")
    plain = F.when(trimmed.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\z"), trimmed.try_cast("double"))
    number = F.coalesce(radix, plain)
    finite = F.when(F.abs(number) < math.inf, number)
    return F.when(trimmed == "", F.lit(0.0)).otherwise(finite) if blank_is_zero else finite


def gps_tile_of_raw(raw: Column) -> Column:
    """Tile of a variant: its gpsTile text, else from the first usable latitude and longitude keys."""
    own = normalized(F.try_variant_get(raw, "$.gpsTile", "string"))
    at = {}
    for axis, keys in GPS_KEYS.items():
        at[axis] = F.coalesce(*[finite_number(F.try_variant_get(raw, f"$.{k}", "string")) for k in keys])
    return F.coalesce(own, gps_tile(at["lat"], at["lon"]))


def fingerprint(size: Column, mtime_ms: Column, head: Column) -> Column:
    """size:whole-millisecond mtime:hash of the first 64 KiB."""
    return F.concat_ws(":", size.cast("bigint").cast("string"), F.floor(mtime_ms).cast("string"), head)


def head_key(text: Column | str) -> Column:
    """size:hash of a fingerprint with exactly three parts, finite size and a hash that isn't empty."""
    parts = F.split(text, ":", -1)
    size, head = finite_number(F.try_element_at(parts, F.lit(1)), blank_is_zero=True), F.try_element_at(parts, F.lit(3))
    shown = F.when(size == F.floor(size), size.cast("bigint").cast("string")).otherwise(size.cast("string"))
    return F.when((F.size(parts) == 3) & size.isNotNull() & (head != ""), F.concat_ws(":", shown, head))


def natural_key(source: Column, path: Column, archive: Column, inner: Column) -> Column:
    """sourceId:archive:archivePath::innerPath or sourceId:file:path."""
    in_archive = F.concat(source, F.lit(":archive:"), F.coalesce(archive, F.lit("")), F.lit("::"), F.coalesce(inner, F.lit("")))
    return F.when(archive.isNotNull() & inner.isNotNull(), in_archive).otherwise(F.concat(source, F.lit(":file:"), F.coalesce(path, F.lit(""))))


def extension(path: Column | str) -> Column:
    """Lower-case extension of the last path part with its dot; empty where there is none or it begins the name."""
    base = F.regexp_extract(path, "([^/]*)/*\\z", 1)
    return F.lower(F.regexp_extract(base, "^.+?(\\.[^.]*)\\z", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def media_kind(path: Column | str) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*PHOTO_EXTENSIONS), "photo").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("unknown")


def metadata_mime(path: Column | str) -> Column:
    return _lookup(METADATA_MIME, extension(path))


def served_mime(path: Column | str) -> Column:
    return F.coalesce(_lookup(SERVED_MIME, extension(path)), F.lit("application/octet-stream"))


def container_mime(format_names: Column | str) -> Column:
    """MIME type of a video container's list of format names."""
    low = F.lower(format_names)
    return F.when(low.contains("mp4") | low.contains("mov"), "video/mp4").when(low.contains("matroska") | low.contains("webm"), "video/webm")


def exif_ms(text: Column | str) -> Column:
    """Epoch milliseconds of a camera's yyyy:MM:dd HH:mm:ss or an ISO time; without zone in the session's."""
    iso = F.regexp_replace(strip(text), "^(\\d{4}):(\\d{2}):(\\d{2}) ", "$1-$2-$3T")
    return F.unix_millis(F.try_to_timestamp(iso))


def duration_ms(seconds: Column | str) -> Column:
    """Whole milliseconds, halves up."""
    return F.floor(finite_number(seconds, blank_is_zero=True) * 1000 + 0.5).cast("bigint")


def content_path(sha: Column | str) -> Column:
    """media/sha256/aa/bb/hash."""
    return F.concat_ws("/", F.lit("media"), F.lit("sha256"), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha if isinstance(sha, Column) else F.col(sha))


def file_sha256(content: Column | str) -> Column:
    """Digest of a file's bytes."""
    return F.sha2(content, 256)


#: Bytes at the start of a file that its fingerprint covers.
HEAD_BYTES = 65_536


def head_sha256(content: Column | str) -> Column:
    """Digest of a file's first 64 KiB."""
    return F.sha2(F.substring(content, 1, HEAD_BYTES), 256)


def minted(prefix: str, *parts: Column) -> Column:
    """An id prefix_uuid that depends on the parts only; null if one is null."""
    digest = F.md5(F.concat_ws("\u001f", F.lit(prefix), *parts))
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    there = F.lit(True)
    for p in parts:
        there &= p.isNotNull()
    return F.when(there, F.concat(F.lit(f"{prefix}_"), F.concat_ws("-", *pieces)))


def threshold(value: object, fallback: int) -> int:
    """A whole number of at least 0 from a finite one; else ``fallback``."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return max(0, math.floor(value)) if number else fallback


def derived_path(media_id: Column, kind: Column) -> Column:
    return F.concat_ws("/", F.lit("derived"), F.substring(media_id, 1, 2), media_id, F.concat(kind, F.lit(".jpg")))


def retry_delay_ms(attempt: Column) -> Column:
    """500 ms doubled with each attempt, 30 s at most."""
    return F.least(F.lit(30_000), F.lit(500) * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)), F.lit(32)) - 1)).cast("bigint")


def canonical_json(text: Column | str) -> Column:
    """JSON with sorted keys and without blanks; null where the text isn't complete JSON."""
    return F.to_json(F.try_parse_json(text))


def format_bytes(value: Column) -> Column:
    """Bytes, or KB to TB in steps of 1024 with one decimal."""
    text = F.concat(value.cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        text = F.when(value >= 1024**power, F.format_string(f"%.1f {unit}", value / float(1024**power))).otherwise(text)
    return text


def duplicate_level(text: Column | str) -> Column:
    low = F.lower(strip(text))
    return F.when(low.isin(*LEVELS), low)


def ordered_distinct(items: Column | str) -> Column:
    """Trimmed items without blanks and repetitions, in the order they come first."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != ""))


def bench_sha(i: Column) -> Column:
    return F.repeat(F.lpad(F.lower(F.hex(i)), 8, "0"), 8)


def dhash64(pixels: Column) -> Column:
    """Difference hash of 9 x 8 grey values in rows: a bit for each value greater than its right neighbour; null if too few."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(
            F.get(pixels, (F.floor(i / 8) * 9 + i % 8).cast("int")) > F.get(pixels, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")), "1"
        ).otherwise("0"),
    )
    return F.when(F.size(pixels) >= 72, F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0")))


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: ** any text, * any within a path part, ? one character of any kind but a line end."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif glob[i] == "*":
            out.append("[^/]*")
        elif glob[i] == "?":
            out.append(".")
        else:
            out.append(glob[i] if glob[i].isalnum() or glob[i] in "_/-" else "\\" + glob[i])
        i += 1
    return "^" + "".join(out) + "\\z"


def excluded(path: Column | str, globs: list[str]) -> Column:
    """Whether a relative path or one of the folders above it matches a glob."""
    if not globs:
        return F.lit(False)
    pattern = "|".join(f"(?:{glob_regex(g)})" for g in globs)
    parts = F.split(path, "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(levels, lambda p: p.rlike(pattern))


#: Fixed value: a line of the search benchmark's report.
BENCH_LINE = "^(.+?) \\| result=(\\d+) \\| min=(\\d+(?:\\.\\d+)?)ms \\| p50=(\\d+(?:\\.\\d+)?)ms \\| p95=(\\d+(?:\\.\\d+)?)ms \\| avg=(\\d+(?:\\.\\d+)?)ms \\| max=(\\d+(?:\\.\\d+)?)ms$"


def bench_line(line: Column | str) -> Column:
    """name, resultSize, minMs, p50Ms, p95Ms, avgMs, maxMs of a line of the benchmark's report; null for other lines."""
    text = strip(line)
    numbers = [F.regexp_extract(text, BENCH_LINE, i + 3).try_cast("double").alias(n) for i, n in enumerate(("minMs", "p50Ms", "p95Ms", "avgMs", "maxMs"))]
    return F.when(text.rlike(BENCH_LINE), F.struct(strip(F.regexp_extract(text, BENCH_LINE, 1)).alias("name"), F.regexp_extract(text, BENCH_LINE, 2).try_cast("bigint").alias("resultSize"), *numbers))


def job_colour(status: Column) -> Column:
    """The colour a job's status is shown in."""
    return F.when(status == "completed", "green").when(status == "failed", "red").when(status == "running", "yellow").otherwise("gray")
