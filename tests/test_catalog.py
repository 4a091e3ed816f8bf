"""Search, scalars, views and pipeline on small fixtures."""

import json
import random

from pyspark.sql import functions as F

from skeinlake.functions import scalars as S
from skeinlake.operators import commands, extraction, pipeline, search, views
from skeinlake.operators.search import SearchRequest


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def catalog(spark):
    media = spark.createDataFrame([("A", "abcdefff" * 8, "ea"), ("B", "ABF01234" * 8, "eb"), ("C", "deadbeef" * 8, "ec")], "mediaId string, sha256 string, sourceEntryId string")
    metadata = spark.createDataFrame(
        [
            ("A", "photo", 1704190272000.0, " Canon EOS R6", "IMAGE/jpeg", '{"gpsLatitude": 55.751, "gpsLongitude": "37.617"}'),
            ("B", "video", 1704276672000.5, "Sony A7", "video/mp4", '{"gpsTile": " X:Y "}'),
            ("D", "photo", None, None, None, None),
        ],
        "mediaId string, kind string, takenAt double, cameraModel string, mimeType string, raw string",
    )
    entries = spark.createDataFrame([("ea", "s1"), ("eb", "s1"), ("ec", "s2")], "sourceEntryId string, sourceId string")
    links = spark.createDataFrame([("A", "eb", "strong"), ("A", "zz", "exact")], "mediaId string, sourceEntryId string, level string")
    return search.catalog_view(media, metadata, entries, links)


def ids(spark, view, **request):
    return [r["mediaId"] for r in search.page(view, SearchRequest(**request)).collect()]


def test_filters(spark):
    view = catalog(spark).cache()
    for prefix, want in {"AB": ["A", "B"], "ABC": ["A"], "ABCDEFFFA": ["A"], ("abcdefff" * 8).upper(): ["A"], "ABF01": ["B"], "DE": ["C"], "f" * 64: [], "A": [], "ZZZ": []}.items():
        assert ids(spark, view, sha256_prefix=prefix) == want, prefix
    both = dict(kind="photo", mime_type="image/JPEG ", source_id="s1", duplicate_level="strong", camera_model="canon eos r6", taken_day="2024-01-02", gps_tile="55.7:37.6", sha256_prefix="ABCDEF")
    assert ids(spark, view, **both) == ["A"]
    assert ids(spark, view, duplicate_level="strong") == ["A", "B"] and ids(spark, view, gps_tile="x:y") == ["B"]
    assert ids(spark, view, taken_day="20240102") == []
    # An id that only metadata names counts but has no row.
    assert ids(spark, view, kind="photo") == ["A"] and search.total(view, SearchRequest(kind="photo")).head()[0] == 2
    assert ids(spark, view) == ["A", "B", "C"]


def test_pages(spark):
    view = spark.createDataFrame([("med_100", 200.0), ("med_200", 200.0), ("med_300", 100.0), ("med_400", None)], "mediaId string, takenAt double")
    view = view.select("*", F.lit(True).alias("present"), F.lit("photo").alias("kind")).cache()
    q = dict(kind="photo", sort="takenAt_desc", limit=2)
    assert ids(spark, view, **q) == ["med_100", "med_200"]
    assert ids(spark, view, **q, cursor="med_200") == ["med_300", "med_400"]
    assert ids(spark, view, **q, cursor="med_400") == []
    assert ids(spark, view, **q, cursor="med_999") == ["med_100", "med_200"]
    assert ids(spark, view, kind="photo", cursor="med_250") == ["med_300", "med_400"]
    assert search.next_cursor(["a", "b"], SearchRequest(limit=2)) == "b" and search.next_cursor(["a"], SearchRequest(limit=2)) is None
    assert SearchRequest(limit="0", offset=-1).page() == (100, 0) and SearchRequest(limit=9999).page() == (500, 0)
    bad = SearchRequest(duplicate_level="near", taken_day="20240102", gps_tile=" ", sha256_prefix="xyz", sort="z", cursor="a", offset=0).errors()
    assert len(bad) == 6 and SearchRequest().errors() == ["search_filter_required"]


def test_scalars(spark):
    row = one(
        spark,
        S.gps_tile(F.lit(-0.05), F.lit(37.617)), S.taken_day(F.lit(-1.0)), S.head_key(F.lit("5:x:h")), S.head_key(F.lit("fp-a")), S.head_key(F.lit("1e1:2:h")),
        S.hamming(F.lit("0" * 16), F.lit("F" * 16)), S.hamming(F.lit("zz"), F.lit("0" * 16)), S.finite_number(F.lit("0x10")), S.finite_number(F.lit("NaN")), S.finite_number(F.lit("1d")),
        S.finite_number(F.lit(" "), True), S.finite_number(F.lit(" ")), S.media_kind(F.lit("a/B.JPG")), S.media_kind(F.lit("a/.jpg")), S.metadata_mime(F.lit("x.tif")), S.served_mime(F.lit("x.tif")),
        S.content_path(F.lit("abcdef")), S.canonical_json(F.lit('{"b":1.0,"a":[1]}')), S.format_bytes(F.lit(1536)), S.container_mime(F.lit("matroska,webm")), S.duration_ms(F.lit("1.2345")),
    )
    assert list(row) == [
        "-0.1:37.6", "1970-01-01" if row[1] == "1970-01-01" else "1969-12-31", "5:h", None, "10:h", 64, None, 16.0, None, None, 0.0, None, "photo", "unknown", "image/tiff",
        "application/octet-stream", "media/sha256/ab/cd/abcdef", '{"a":[1],"b":1}', "1.5 KB", "video/webm", 1235,
    ]
    pixels = [(i * 37) % 11 for i in range(72)]
    bits = "".join("1" if pixels[r * 9 + c] > pixels[r * 9 + c + 1] else "0" for r in range(8) for c in range(8))
    got = one(spark, S.dhash64(F.array(*map(F.lit, pixels))), S.dhash64(F.array(F.lit(1))))
    assert list(got) == [f"{int(bits, 2):016x}", None]
    paths = spark.createDataFrame([("a/b/c.tmp",), ("x/private/y",), ("keep.jpg",)], "p string").select(S.excluded("p", ["**/private", "*/b"]))
    assert [r[0] for r in paths.collect()] == [True, True, False]


def log_of(spark, *events):
    rows = [(i + 1, (f"e{i}", kind, float(i + 1), None, payload)) for i, (kind, payload) in enumerate(events)]
    return views.typed(spark.createDataFrame(rows, "seq bigint, event struct<eventId string, type string, createdAt double, jobId string, payload string>"))


def test_job_view(spark):
    e = log_of(
        spark,
        ("JOB_ENQUEUED", '{"jobId":"a","kind":"scan"}'), ("JOB_STARTED", '{"jobId":"a","attempt":1}'), ("JOB_RETRY_SCHEDULED", '{"jobId":"a","attempt":1,"retryAt":1234,"error":"tool_missing"}'),
        ("JOB_ENQUEUED", '{"jobId":"b","kind":"scan"}'), ("JOB_STARTED", '{"jobId":"b","attempt":1}'), ("JOB_COMPLETED", '{"jobId":"b"}'), ("JOB_STARTED", '{"jobId":"ghost","attempt":1}'),
    )
    got = {r["jobId"]: (r["status"], r["attempts"], r["updatedAt"], r["lastError"]) for r in views.jobs(e).collect()}
    assert got == {"a": ("queued", 1, 1234.0, "tool_missing"), "b": ("completed", 1, 6.0, None)}
    assert [r[0] for r in views.orphan_job_events(e).collect()] == ["ghost"]
    active = pipeline.without_active(spark.createDataFrame([("scan", None), ("x", '{"a": 1}')], "kind string, payload string"), views.jobs(e).withColumn("payload", F.lit(None).cast("string")))
    assert [r["kind"] for r in active.collect()] == ["x"]


def test_quarantine_link_and_album_views(spark):
    e = log_of(
        spark,
        ("QUARANTINE_CREATED", '{"item":{"quarantineId":"q1","sourceEntryId":"e","candidateMediaIds":["A","B"],"status":"pending","createdAt":1}}'),
        ("QUARANTINE_CREATED", '{"item":{"quarantineId":"q2","sourceEntryId":"e","candidateMediaIds":["C"],"status":"pending","createdAt":2}}'),
        ("QUARANTINE_ACCEPTED", '{"quarantineId":"q1","acceptedMediaId":"B","resolvedAt":1234}'),
        ("QUARANTINE_REJECTED", '{"quarantineId":"q1","rejectedReason":"late"}'),
        ("DUPLICATE_LINK_CREATED", '{"link":{"duplicateLinkId":"l1","mediaId":"B","sourceEntryId":"e","level":"probable"}}'),
        ("DUPLICATE_LINK_CREATED", '{"link":{"duplicateLinkId":"l2","mediaId":"B","sourceEntryId":"e","level":"probable"}}'),
        ("ALBUM_CREATED", '{"album":{"albumId":"x","name":"Trip","mediaIds":["A"]}}'), ("ALBUM_REMOVED", '{"albumId":"x"}'), ("ALBUM_CREATED", '{"album":{"albumId":"x","name":"Again","mediaIds":["Z"]}}'),
    )
    items = [(r["quarantineId"], r["status"], r["acceptedMediaId"], r["resolvedAt"]) for r in views.quarantine(e).collect()]
    assert items == [("q1", "accepted", "B", 1234.0)]
    assert [r["duplicateLinkId"] for r in views.links(e).collect()] == ["l1"]
    assert [(r["name"], r["pos"]) for r in views.albums(e).collect()] == [("Again", 9)]
    assert [tuple(r) for r in pipeline.missing_members(views.albums(e), spark.createDataFrame([("A",)], "mediaId string")).collect()] == [("x", "Z")]


def test_incremental_index(spark):
    up = '{"entry":{"sourceEntryId":"e","sourceId":"%s"}}'
    e = log_of(
        spark,
        ("MEDIA_IMPORTED", '{"media":{"mediaId":"early","sourceEntryId":"e"}}'), ("SOURCE_ENTRY_UPSERTED", up % "s1"), ("MEDIA_IMPORTED", '{"media":{"mediaId":"m","sourceEntryId":"e"}}'),
        ("SOURCE_REMOVED", '{"sourceId":"s1"}'), ("MEDIA_IMPORTED", '{"media":{"mediaId":"late","sourceEntryId":"e"}}'), ("DUPLICATE_LINK_CREATED", '{"link":{"mediaId":"x","sourceEntryId":"e","level":"exact"}}'),
    )
    assert {tuple(r) for r in views.import_sources(e).collect()} == {("m", "s1")}
    assert {tuple(r) for r in views.import_levels(e).collect()} == {("x", "exact"), ("late", "exact")}


NEAR = "entry string, mediaId string, head string, phash string, state string, rank int"


def near(spark, a, b, heads, **limits):
    rows = [("ea", "A", heads[0], a, "active", 1), ("eb", "B", heads[1], b, "active", 2)]
    return {r["entry"]: (r["outcome"], r["mediaId"], r["candidateMediaIds"]) for r in pipeline.classify_near(spark.createDataFrame(rows, NEAR), **limits).collect()}


def test_near_duplicates(spark):
    differ = ("1:a", "1:b")
    assert near(spark, "abcdef0000000000", "abcdef0000000001", differ, strong=0, probable=2)["eb"] == ("quarantine", None, ["B", "A"])
    assert near(spark, "abcdef0000000000", "abcdef0000000001", differ)["eb"] == ("strong", "A", None)
    assert near(spark, "1234000000000000", "12340000000000ff", differ)["ea"] == ("quarantine", None, ["A", "B"])
    assert near(spark, "0" * 16, "f" * 16, ("1:a", "1:a")) == {}
    assert near(spark, "00000000000000ff", "00000000000000e0", ("1:a", "1:a"))["ea"][0] == "quarantine"
    assert near(spark, None, None, ("1:a", "1:a"))["ea"] == ("quarantine", None, ["A", "B"])
    assert near(spark, None, None, (None, None)) == {}


def test_scan_and_ingest(spark):
    listing = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("n", 3, 3.0)], "path string, size bigint, mtimeMs double")
    known = spark.createDataFrame([("a", "ea", 1, 1.0, "active"), ("b", "eb", 2, 9.0, "active"), ("g", "eg", 1, 1.0, "active"), ("h", "eh", 1, 1.0, "missing")], "path string, sourceEntryId string, size bigint, mtimeMs double, state string")
    assert {r["path"]: r["outcome"] for r in pipeline.scan_diff(listing, known).collect()} == {"a": "unchanged", "b": "changed", "n": "new", "g": "missing"}
    incoming = spark.createDataFrame([("e1", "x", 1), ("e2", "x", 2), ("e3", "y", 3), ("e4", None, 4)], "entry string, sha256 string, rank int")
    got = {r["entry"]: (r["imported"], r["original"]) for r in pipeline.exact_dedup(incoming, spark.createDataFrame([("y", "M")], "sha256 string, mediaId string")).collect()}
    assert got == {"e1": (True, None), "e2": (False, "e1"), "e3": (False, "M")}


def test_scan_keeps_fingerprints_and_marks_missing(spark):
    listing = spark.createDataFrame([("a", 1, 1.5, "h1"), ("b", 2, 2.0, "h2"), ("n", 3, 3.9, "h3")], "path string, size bigint, mtimeMs double, head string")
    known = spark.createDataFrame(
        [("a", "ea", 1, 1.5, "old", "missing"), ("b", "eb", 2, 9.0, "old", "active"), ("g", "eg", 1, 1.0, "old", "active"), ("h", "eh", 1, 1.0, "old", "missing")],
        "path string, sourceEntryId string, size bigint, mtimeMs double, fingerprint string, state string",
    )
    got = {r["path"]: (r["type"][13:], r["fingerprint"], r["ingest"], r["state"]) for r in commands.scan_events(listing, known, "s", 7.0).collect()}
    assert got == {"a": ("UPSERTED", "old", False, "active"), "b": ("UPSERTED", "2:2:h2", True, "active"), "n": ("UPSERTED", "3:3:h3", True, "active"), "g": ("MARKED_MISSING", None, False, "missing")}
    first = commands.scan_events(listing, known, "s", 7.0).where("path = 'n'").head()["sourceEntryId"]
    assert first == commands.scan_events(listing, known, "s", 8.0).where("path = 'n'").head()["sourceEntryId"] and first.startswith("se_")


def test_near_events_respect_the_state(spark):
    columns = NEAR + ", imported boolean, quarantined boolean, linked boolean"
    a, b = ("ea", "A", "1:a", "abcdef0000000000", "active", 1), ("eb", "B", "1:b", "abcdef0000000001", "active", 2)

    def events(flags_a, flags_b):
        rows = spark.createDataFrame([a + flags_a, b + flags_b], columns)
        return {r["sourceEntryId"]: (r["type"], r["mediaId"], r["reason"]) for r in commands.near_events(rows).collect()}

    plain, link = (True, False, False), ("DUPLICATE_LINK_CREATED", "A", "perceptual-hamming<=4:1")
    assert events(plain, plain)["eb"] == link
    assert events((True, True, False), plain) == {}  # one is in review: neither is decided
    assert set(events(plain, (True, False, True))) == {"ea"}  # the other has its strong link
    assert events((False, False, False), plain) == {}


def test_search_response_and_codes(spark):
    view = spark.createDataFrame([(f"m{i}", float(i), i != 2) for i in range(5)], "mediaId string, takenAt double, present boolean").withColumn("kind", F.lit("photo")).cache()
    got = search.respond(view, SearchRequest(kind="photo", limit=3))
    assert [r["mediaId"] for r in got["media"]] == ["m0", "m1"] and got["total"] == 5 and got["nextCursor"] == "m2"  # a full page, one id of which has no row
    rest = search.respond(view, SearchRequest(kind="photo", limit=3, cursor=got["nextCursor"]))
    assert [r["mediaId"] for r in rest["media"]] == ["m3", "m4"] and rest["nextCursor"] is None and rest["filters"]["kind"] == "photo"
    assert search.respond(view, SearchRequest(kind="photo", limit=3, offset=0))["nextCursor"] is None
    codes = {
        "invalid_sort": dict(sort="x"), "invalid_kind_filter": dict(kind="audio"), "invalid_mime_type_filter": dict(mime_type=" "), "invalid_source_id_filter": dict(source_id=""),
        "invalid_duplicate_level_filter": dict(duplicate_level="near"), "invalid_camera_model_filter": dict(camera_model=" "), "invalid_taken_day_filter": dict(taken_day="2024-1-1"),
        "invalid_gps_tile_filter": dict(gps_tile=""), "invalid_sha256_prefix_filter": dict(sha256_prefix="a"), "search_filter_required": {}, "invalid_cursor": dict(kind="photo", cursor=" "),
        "invalid_pagination_params": dict(kind="photo", cursor="a", offset=0),
    }
    for code, request in codes.items():
        assert SearchRequest(**request).errors()[0] == code
    assert SearchRequest(kind="photo", sha256_prefix=" AB ").filters()["sha256Prefix"] == "ab" and not SearchRequest(kind="video").errors()


def test_extraction(spark):
    photo = '[{"ImageWidth":"640","ImageHeight":480,"Model":" X ","DateTimeOriginal":null,"CreateDate":"2024:01:02 03:04:05","Tags":{"a":1}}]'
    video = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":10,"height":20,"codec_name":"h264"}],"format":{"duration":"1.2345","format_name":"matroska,webm","tags":{"creation_time":"2024-01-02T03:04:05Z"}}}'
    rows = [("a.JPG", 9.0, photo, [1] * 72), ("b.mkv", 9.0, video, None), ("c.jpg", 9.0, "{cut", None), ("d.mov", 9.0, None, [9 - i % 9 for i in range(72)]), ("e.txt", 9.0, photo, [1] * 72), ("f.png", None, "[]", None), (None, 1.0, None, None)]
    got = {r["path"]: r["metadata"] for r in extraction.extract(spark.createDataFrame(rows, "path string, mtimeMs double, toolOutput string, pixels array<int>")).collect()}
    taken = 1704164645000.0
    assert tuple(got["a.JPG"])[:7] == ("photo", taken, 640, 480, None, "X", "image/jpeg")
    raw = json.loads(got["a.JPG"]["raw"])
    assert raw == {"extractor": "exiftool", "imageWidth": "640", "imageHeight": 480, "model": " X ", "dateTimeOriginal": None, "createDate": "2024:01:02 03:04:05", "ext": ".jpg", "perceptualHash": "0" * 16}
    assert tuple(got["b.mkv"])[:7] == ("video", taken, 10, 20, 1235, None, "video/webm") and json.loads(got["b.mkv"]["raw"])["codecName"] == "h264"
    assert tuple(got["c.jpg"])[:7] == ("photo", 9.0, None, None, None, None, "image/jpeg") and json.loads(got["c.jpg"]["raw"]) == {"ext": ".jpg"}
    assert json.loads(got["d.mov"]["raw"]) == {"ext": ".mov", "perceptualHash": "f" * 16}
    assert tuple(got["e.txt"])[:7] == ("unknown", 9.0, None, None, None, None, None) and json.loads(got["e.txt"]["raw"]) == {"ext": ".txt"}
    assert json.loads(got["f.png"]["raw"])["extractor"] == "exiftool" and got["f.png"]["takenAt"] is None


def test_small_scalars(spark):
    row = one(spark, S.valid_day(F.lit(" 2024-13-99 ")), S.valid_day(F.lit("2024-1-1")), S.derived_path(F.lit("med_1"), F.lit("thumb")), S.exif_ms(F.lit("2024:01:02 03:04:05")), S.exif_ms(F.lit("none")), S.job_colour(F.lit("running")), S.bench_line(F.lit("no line")))
    assert list(row) == ["2024-13-99", None, "derived/me/med_1/thumb.jpg", 1704164645000, None, "yellow", None]
    assert [S.threshold(x, 4) for x in (3.9, -1, None, float("nan"), "7", 0)] == [3, 0, 4, 4, 4, 0]
    clamp = spark.createDataFrame([(10, 4, 20), (10, 4, 3), (0, 4, 8), (8, 4, 8)], "total bigint, l bigint, o bigint").select(search.last_page_offset(F.col("total"), F.col("l"), F.col("o")))
    assert [r[0] for r in clamp.collect()] == [8, 3, 0, 4]
    steps = spark.createDataFrame([(3, 3, True), (1, 3, True), (1, 3, False)], "a int, m int, h boolean").select(pipeline.next_step(F.col("a"), F.col("m"), F.col("h")))
    assert [r[0] for r in steps.collect()] == ["failed", "retry", "failed"]
    media = spark.createDataFrame([("A", "ea"), ("B", "eb")], "mediaId string, sourceEntryId string")
    served = pipeline.served_types(media, spark.createDataFrame([("A", "x/y")], "mediaId string, mimeType string"), spark.createDataFrame([("ea", "a.jpg"), ("eb", "b.svg")], "sourceEntryId string, path string"))
    assert {tuple(r) for r in served.collect()} == {("A", "x/y"), ("B", "image/svg+xml")}
    globs = spark.createDataFrame([("a/b",), ("axb",)], "p string").select(S.excluded("p", ["a?b"]))
    assert [r[0] for r in globs.collect()] == [True, True]


def test_running_totals_over_ranges(spark):
    r = random.Random(3)
    trace = [("hot" if i % 3 else f"k{i % 7}", i, r.choice([1, -1])) for i in range(400)]
    want, now = {}, {}
    for kind, _, change in trace:
        now[kind] = now.get(kind, 0) + change
        want[kind] = max(want.get(kind, -999), now[kind])
    got = pipeline.running_at_once(spark.createDataFrame(trace, "kind string, at bigint, change int").repartition(6))
    assert {tuple(x) for x in got.collect()} == set(want.items())
    samples = [("g", float(r.randrange(50))) for _ in range(500)] + [("one", 5.0), (None, 1.0), ("none", None)]
    stats = {x["grp"]: tuple(x)[1:] for x in pipeline.latency_stats(spark.createDataFrame(samples, "grp string, v double"), "grp", "v").collect()}
    ordered = sorted(v for g, v in samples if g == "g")
    assert stats["g"][:4] == (ordered[0], ordered[250], ordered[475], ordered[-1]) and abs(stats["g"][4] - sum(ordered) / 500) < 1e-9
    assert stats["one"] == (5.0,) * 5 and set(stats) == {"g", "one", None}
    reset = views.reset_running(spark.createDataFrame([("running",), ("failed",)], "status string"))
    assert [x[0] for x in reset.collect()] == ["queued", "failed"]
