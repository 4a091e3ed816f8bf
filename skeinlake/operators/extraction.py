"""Metadata of media from the JSON that extraction tools print, with a fallback to what a path tells.

The tools themselves aren't run: their output is an input column, null where a tool failed. Output
that isn't complete JSON counts as failed, and the metadata then is the basic one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions import scalars as S

FIELDS = ("kind", "takenAt", "width", "height", "durationMs", "cameraModel", "mimeType")


def _get(variant: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(variant, path, kind)


def _primitive(value: Column) -> Column:
    """A variant that is a text, number, boolean or JSON null; objects and lists count as absent."""
    shape = F.schema_of_variant(value)
    return F.when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), value)


def _text(value: Column) -> Column:
    """Trimmed text of a variant that is a text and not blank."""
    plain = S.strip(F.try_variant_get(value, "$", "string"))
    return F.when(F.schema_of_variant(value).startswith("STRING") & (plain != ""), plain)


def _number(value: Column) -> Column:
    """A finite number from a JSON number or a numeric text; a blank text is 0."""
    return F.when(F.schema_of_variant(value).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), S.finite_number(F.try_variant_get(value, "$", "string"), blank_is_zero=True))


def sanitized(fields: dict[str, Column]) -> Column:
    """JSON text of the variants that are primitive, in the order given; absent ones are left out."""
    return F.to_json(F.struct(*[_primitive(v).alias(n) for n, v in fields.items()]))


def _first(*values: Column) -> Column:
    """The first variant that is neither absent nor JSON null."""
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in values])


def _lit(text: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(text.alias("x"))))


def _as_variant(text: Column) -> Column:
    return F.variant_get(_lit(text), "$.x", "variant")


def basic(path: Column, mtime_ms: Column) -> Column:
    """Metadata that path and modification time tell."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        S.media_kind(path).alias("kind"), mtime_ms.cast("double").alias("takenAt"), null("int").alias("width"), null("int").alias("height"), null("bigint").alias("durationMs"),
        null("string").alias("cameraModel"), S.metadata_mime(path).alias("mimeType"), F.to_json(F.struct(S.extension(path).alias("ext"))).alias("raw"),
    )


def photo(output: Column, path: Column) -> Column:
    """Metadata from a photo tool's list of one object; null if the output isn't JSON."""
    v = F.try_parse_json(output)
    own = lambda name: _get(v, f"$[0].{name}")
    fields = {
        "extractor": _as_variant(F.lit("exiftool")), "imageWidth": own("ImageWidth"), "imageHeight": own("ImageHeight"), "model": own("Model"), "dateTimeOriginal": own("DateTimeOriginal"),
        "createDate": own("CreateDate"), "mimeType": own("MIMEType"), "ext": _as_variant(S.extension(path)),
    }
    taken = S.exif_ms(_text(_first(own("DateTimeOriginal"), own("CreateDate"), own("ModifyDate")))).cast("double")
    made = F.struct(
        F.lit("photo").alias("kind"), taken.alias("takenAt"), _number(own("ImageWidth")).cast("int").alias("width"), _number(own("ImageHeight")).cast("int").alias("height"),
        F.lit(None).cast("bigint").alias("durationMs"), _text(own("Model")).alias("cameraModel"), _text(own("MIMEType")).alias("mimeType"), sanitized(fields).alias("raw"),
    )
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), made)


def video(output: Column, path: Column) -> Column:
    """Metadata from a video tool's object of format and streams, of which the first video stream counts; null if the output isn't JSON."""
    v = F.try_parse_json(output)
    streams = F.coalesce(F.try_variant_get(v, "$.streams", "array<variant>"), F.array().cast("array<variant>"))
    stream = F.get(F.filter(streams, lambda s: _get(s, "$.codec_type", "string") == "video"), 0)
    form = lambda name: _get(v, f"$.format.{name}")
    fields = {
        "extractor": _as_variant(F.lit("ffprobe")), "formatName": form("format_name"), "duration": form("duration"), "creationTime": form("tags.creation_time"),
        "codecName": _get(stream, "$.codec_name"), "ext": _as_variant(S.extension(path)),
    }
    made = F.struct(
        F.lit("video").alias("kind"), S.exif_ms(_text(form("tags.creation_time"))).cast("double").alias("takenAt"),
        _number(_get(stream, "$.width")).cast("int").alias("width"), _number(_get(stream, "$.height")).cast("int").alias("height"),
        F.floor(_number(form("duration")) * 1000 + 0.5).cast("bigint").alias("durationMs"), F.lit(None).cast("string").alias("cameraModel"),
        S.container_mime(_text(form("format_name"))).alias("mimeType"), sanitized(fields).alias("raw"),
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), made)


def merged(base: Column, extracted: Column) -> Column:
    """Extracted fields where they are there, else the basic ones; raw fields of both, the extracted ones winning."""
    fields = [F.coalesce(extracted[f], base[f]).alias(f) for f in FIELDS]
    kinds = "map<string,string>"
    both = F.map_concat(F.from_json(base["raw"], kinds), F.coalesce(F.from_json(extracted["raw"], kinds), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    raw = F.when(extracted.isNull(), base["raw"]).when(F.map_contains_key(F.from_json(extracted["raw"], kinds), F.lit("ext")), extracted["raw"]).otherwise(F.to_json(both))
    return F.struct(*fields, raw.alias("raw"))


def extract(files: DataFrame) -> DataFrame:
    """The columns of ``files`` and metadata: basic, or from the tool of its kind, with a perceptual hash in raw if there is one.

    ``files``: path, mtimeMs, toolOutput (JSON text), pixels (9 x 8 grey values in rows, or null).
    Kinds other than photo and video stay basic, whatever the other columns hold.
    """
    base = basic(F.col("path"), F.col("mtimeMs"))
    kind = S.media_kind("path")
    found = F.when(kind == "photo", photo(F.col("toolOutput"), F.col("path"))).when(kind == "video", video(F.col("toolOutput"), F.col("path")))
    rows = files.withColumn("_base", base).withColumn("_found", found)
    rows = rows.withColumn("_m", merged(F.col("_base"), F.col("_found")))
    phash = F.when(kind.isin("photo", "video"), S.dhash64(F.col("pixels")))
    # The raw object gets one more field before its closing brace.
    raw = F.when(phash.isNull(), F.col("_m.raw")).otherwise(F.concat(F.expr("substr(_m.raw, 1, length(_m.raw) - 1)"), F.lit(',"perceptualHash":"'), phash, F.lit('"}')))
    return rows.withColumn("metadata", F.struct(*[F.col(f"_m.{f}") for f in FIELDS], raw.alias("raw"))).drop("_base", "_found", "_m")
