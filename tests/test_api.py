import pytest

from skeinlake.operators.search import SearchRequest
from skeinlake.plans.api import Catalog

EVENTS = [
    ("SOURCE_CREATED", '{"source":{"sourceId":"s","path":"/a/b"}}'),
    ("SOURCE_ENTRY_UPSERTED", '{"entry":{"sourceEntryId":"ea","sourceId":"s","kind":"file","path":"x.jpg","fingerprint":"1:2:h","state":"active"}}'),
    ("SOURCE_ENTRY_UPSERTED", '{"entry":{"sourceEntryId":"eb","sourceId":"s","kind":"file","path":"y.jpg","fingerprint":"fp-b","state":"active"}}'),
    ("MEDIA_IMPORTED", '{"media":{"mediaId":"A","sha256":"%s","size":10,"sourceEntryId":"ea"}}' % ("ab" * 32)),
    ("MEDIA_SKIPPED_DUPLICATE_EXACT", '{"sourceEntryId":"eb","existingMediaId":"A"}'),
    ("MEDIA_METADATA_EXTRACTED", '{"mediaId":"A","metadata":{"kind":"photo","takenAt":2,"mimeType":"image/jpeg","raw":{"ext":".jpg","perceptualHash":"abcdef0000000000"}}}'),
    ("QUARANTINE_CREATED", '{"item":{"quarantineId":"q","sourceEntryId":"eb","candidateMediaIds":["A"],"status":"pending","createdAt":1}}'),
    ("QUARANTINE_ACCEPTED", '{"quarantineId":"q","acceptedMediaId":"A","resolvedAt":5}'),
    ("DUPLICATE_LINK_CREATED", '{"link":{"duplicateLinkId":"l","mediaId":"A","sourceEntryId":"eb","level":"probable","reason":"quarantine-accepted"}}'),
    ("ALBUM_CREATED", '{"album":{"albumId":"t","name":"Trip","mediaIds":["A"]}}'),
    ("JOB_ENQUEUED", '{"jobId":"j","kind":"scan"}'),
]


def test_endpoints(spark):
    rows = [(i + 1, (f"e{i}", kind, float(i), None, p)) for i, (kind, p) in enumerate(EVENTS)]
    c = Catalog.of_log(spark.createDataFrame(rows, "seq bigint, event struct<eventId string, type string, createdAt double, jobId string, payload string>"))
    first = lambda df: tuple(df.head() or ())
    assert first(c.metrics()) == (1, 2, 1, 1, 0, 1, 1)
    assert c.sources(["/a"]).count() == 1 and c.sources(["/a/bc"]).count() == 0
    assert [r["sourceEntryId"] for r in c.entries("s").collect()] == ["ea", "eb"]
    detail = c.entry("eb").head()
    assert (detail["status"], detail["quarantineId"], [x["level"] for x in detail["links"]]) == ("duplicate", "q", ["probable"])
    assert c.entry_by_key("s:file:x.jpg").count() == 1 and c.entries_by_head("1:h").count() == 1 and c.linked_entries("probable").count() == 1
    assert [r["mediaId"] for r in c.media_by_hash_prefix("ABCDEF1111111111").collect()] == ["A"] and c.media_by_hash_prefix("abcd").count() == 0
    assert c.media(10).count() == 1 and c.media_item("A").head()["kind"] == "photo" and c.albums().count() == 1
    assert c.duplicate_links("near").count() == 1 and c.duplicate_links("strong").count() == 0 and c.duplicate_links(media_id="A", entry_id="eb").count() == 1
    assert c.quarantine("accepted").head()["resolvedAt"] == 5 and c.quarantine("pending").count() == 0 and c.runnable_jobs().count() == 1
    view = c.search_view()
    assert [r["mediaId"] for r in c.search(view, SearchRequest(duplicate_level="probable", taken_day="1970-01-01", source_id="s")).collect()] == ["A"]
    with pytest.raises(ValueError, match="search_filter_required"):
        c.search(view, SearchRequest())
    answer = c.search_response(view, SearchRequest(duplicate_level="probable"))
    assert [r["mediaId"] for r in answer["media"]] == ["A"] and answer["total"] == 1 and answer["nextCursor"] is None
    assert c.one("media", sha256="ab" * 32).count() == 1 and c.one("album", albumId="t").count() == 1 and c.one("job", jobId="j").count() == 1
    assert c.one("duplicateLink", mediaId="A", sourceEntryId="eb", level="exact").count() == 0
    c.register(spark)
    assert spark.sql("select count(*) from media").head()[0] == 1
