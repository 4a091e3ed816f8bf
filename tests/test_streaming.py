"""Views from a stream of segments, its chain carried from batch to batch, and a state rebuilt from a snapshot."""

import json
import pathlib

import pytest

from skeinlake.operators import views
from skeinlake.sources import log
from skeinlake.streaming.views import EventStore, maintain_events

SECRET = b"test-secret"


def event(i, type_, /, **payload):
    return {"eventId": f"e{i}", "type": type_, "createdAt": float(i), "payload": payload}


FIRST = [
    event(1, "SOURCE_CREATED", source={"sourceId": "s", "path": "/a"}),
    event(2, "SOURCE_ENTRY_UPSERTED", entry={"sourceEntryId": "ea", "sourceId": "s", "state": "active"}),
    event(3, "MEDIA_IMPORTED", media={"mediaId": "A", "sha256": "ab", "size": 1, "sourceEntryId": "ea"}),
    event(4, "QUARANTINE_CREATED", item={"quarantineId": "q", "sourceEntryId": "eb", "candidateMediaIds": ["A"], "status": "pending", "createdAt": 4}),
    event(5, "QUARANTINE_ACCEPTED", quarantineId="q", acceptedMediaId="A", resolvedAt=5),
    event(6, "JOB_ENQUEUED", jobId="j", kind="scan"),
    event(7, "MEDIA_METADATA_EXTRACTED", mediaId="A", metadata={"kind": "photo", "raw": {"ext": ".jpg", "perceptualHash": "abcdef0000000000"}}),
]
SECOND = [
    event(8, "SOURCE_ENTRY_UPSERTED", entry={"sourceEntryId": "eb", "sourceId": "s", "state": "active"}),
    event(9, "MEDIA_SKIPPED_DUPLICATE_EXACT", sourceEntryId="eb", existingMediaId="A"),
    event(10, "DUPLICATE_LINK_CREATED", link={"duplicateLinkId": "l", "mediaId": "A", "sourceEntryId": "eb", "level": "exact"}),
    event(11, "QUARANTINE_REJECTED", quarantineId="q", rejectedReason="late"),
    event(12, "ALBUM_CREATED", album={"albumId": "t", "name": "Trip", "mediaIds": ["A"]}),
    event(13, "SOURCE_REMOVED", sourceId="s"),
    event(14, "SOURCE_ENTRY_UPSERTED", entry={"sourceEntryId": "ea", "sourceId": "s", "state": "missing"}),
]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "wal")
    log.append(spark, path, FIRST, SECRET, 1.0)
    log.append(spark, path, SECOND, SECRET, 2.0)
    return path


def rows(tables):
    return {name: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in t.collect()) for name, t in tables.items()}


def test_stream_keeps_every_view(spark, folder, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert all(t.count() == 0 for t in store.views().values())
    stream = log.stream_log(spark, folder)
    maintain_events(stream, store, str(tmp_path / "cp"), verify=True, secret=SECRET).awaitTermination()
    events = views.typed(log.read_log(spark, folder))
    want = rows(views.domain_views(events) | {"job": views.jobs(events)})
    assert rows(store.views()) == want and len(want) == 9 and all(n == "source" or t for n, t in want.items())
    log.append(spark, folder, [event(15, "ALBUM_REMOVED", albumId="t")], SECRET, 3.0)
    maintain_events(stream, store, str(tmp_path / "cp"), verify=True, secret=SECRET).awaitTermination()
    assert store.views()["album"].count() == 0
    store.put(1, log.read_log(spark, folder).where("seq = 15"))  # delivered again
    store.compact(1)
    assert store.views()["album"].count() == 0 and rows({"media": store.views()["media"]})["media"] == want["media"]


def test_a_chain_broken_between_batches_stops_the_stream(spark, folder, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    maintain_events(log.stream_log(spark, folder), store, str(tmp_path / "cp"), verify=True, secret=SECRET).awaitTermination()
    other = str(tmp_path / "other")
    log.append(spark, other, FIRST + SECOND + [event(15, "JOB_STARTED", jobId="j", attempt=1)], b"another", 9.0, max_bytes=1)
    stray = sorted(pathlib.Path(other).glob("??????.jsonl"))[-1]
    pathlib.Path(folder, "000003.jsonl").write_text(stray.read_text())
    query = maintain_events(log.stream_log(spark, folder), store, str(tmp_path / "cp"), verify=True, secret=SECRET)
    with pytest.raises(Exception, match="record 15"):
        query.awaitTermination()


def test_rebuild_from_snapshot_and_tail(spark, folder, tmp_path):
    whole = rows(log.rebuild_state(spark, folder, None, SECRET))
    for cut in (0, 5, 7, 12, 14):
        snapshots = str(tmp_path / f"snapshots{cut}")
        early = views.typed(log.read_log(spark, folder).where(f"seq <= {cut}"))
        log.write_snapshot(spark, snapshots, views.domain_views(early), cut, 1000, "t")
        assert rows(log.rebuild_state(spark, folder, snapshots, SECRET)) == whole, cut


def test_digests_of_files(spark, tmp_path):
    import hashlib

    content = bytes(range(256)) * 300
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(content)
    got = log.digests(spark, str(tmp_path / "f")).head()
    assert (got["sha256"], got["head"]) == (hashlib.sha256(content).hexdigest(), hashlib.sha256(content[:65536]).hexdigest())


def test_contents_are_stored_once(spark, tmp_path):
    import hashlib

    from skeinlake.sources.vault import store

    (tmp_path / "in" / "deep").mkdir(parents=True)
    contents = {"a.bin": b"one", "deep/b.bin": b"two" * 1000, "deep/same.bin": b"one", "third": b"3"}
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    vault = tmp_path / "vault"
    rows = store(spark, str(tmp_path / "in"), str(vault)).collect()
    assert {r["path"].rpartition("/in/")[2]: r["sha256"] for r in rows} == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    held = {p for p in vault.rglob("*") if p.is_file()}
    assert len(held) == 3 and all(hashlib.sha256(p.read_bytes()).hexdigest() == p.name and p.parent.name == p.name[2:4] for p in held)
    assert not any(r["stored"] for r in store(spark, str(tmp_path / "in"), str(vault)).collect())
