import hashlib
import hmac
import json

import pytest

from skeinlake.operators import views
from skeinlake.sources import log

SECRET = b"test-secret"
EVENTS = [{"eventId": f"e{i}", "type": "SOURCE_CREATED", "createdAt": 1.5 + i, "payload": {"source": {"sourceId": f"s{i}", "path": "/é", "n": 1e21}}} for i in range(4)]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "wal")
    assert log.append(spark, path, EVENTS[:2], SECRET, 10.0) == 2
    assert log.append(spark, path, EVENTS[2:], SECRET, 11.0, max_bytes=10) == 4
    return path


def segments(folder):
    import pathlib

    return sorted(pathlib.Path(folder).glob("??????.jsonl"))


def rewrite(path, text):
    path.write_text(text)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def test_append_read_verify(spark, folder):
    assert [p.name for p in segments(folder)] == ["000001.jsonl", "000002.jsonl", "000003.jsonl"]
    (segments(folder)[0].parent / "notes.jsonl").write_text("junk\n")
    rewrite(segments(folder)[0], segments(folder)[0].read_text() + "\n  \n")
    rows = log.verify(log.read_log(spark, folder), SECRET)
    assert sorted(r["seq"] for r in rows.collect()) == [1, 2, 3, 4]
    assert views.sources(views.typed(rows)).count() == 4
    assert log.last_record(rows).head()["seq"] == 4


@pytest.mark.parametrize(
    "change,reason",
    [
        (lambda r: r["event"].update(type="SOURCE_UPDATED"), "hash"),
        (lambda r: r.update(prevHash="0" * 64), "prev_hash"),
        (lambda r: r.update(schemaVersion=2), "schema_version"),
        (lambda r: r.update(seq=9), "seq"),
    ],
)
def test_tampering_is_found(spark, folder, change, reason):
    path = segments(folder)[0]
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    change(lines[1])
    rewrite(path, "".join(json.dumps(x) + "\n" for x in lines))
    bad = {r["reason"] for r in [log.first_failure(log.read_log(spark, folder), SECRET).head()]}
    assert bad == {"seq" if reason == "seq" else reason}
    with pytest.raises(log.IntegrityError):
        log.verify(log.read_log(spark, folder), SECRET)


def test_lines_that_are_not_json_fail(spark, folder):
    path = segments(folder)[1]
    rewrite(path, path.read_text() + "{broken\n")
    assert log.first_failure(log.read_log(spark, folder), SECRET).count() == 1


def test_missing_folder_is_empty(spark, tmp_path):
    assert log.read_log(spark, str(tmp_path / "none")).count() == 0


def test_hmac_equals_python(spark):
    for secret in (b"k", b"x" * 100):
        got = spark.createDataFrame([("é{}",), ("",), (None,)], "m string").select(log.hmac_sha256(__import__("pyspark").sql.functions.col("m"), secret)).collect()
        assert [r[0] for r in got] == [hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in ("é{}", "")] + [None]


def test_canonical_json():
    assert log.canonical({"b": 1.0, "a": [True, None, "é"], "10": 0, "9": {"z": 1, "y": 2}}) == '{"9":{"y":2,"z":1},"10":0,"a":[true,null,"é"],"b":1}'
    shown = {1e21: "1e+21", 1e20: "100000000000000000000", 1e-7: "1e-7", 0.000001: "0.000001", 1.5: "1.5", -0.0: "0", 123456789012.25: "123456789012.25", 1.2e-9: "1.2e-9", 2**53: "9007199254740992", 1.25e22: "1.25e+22", 0.00001: "0.00001"}
    assert {k: log._number(k) for k in shown} == shown


def test_snapshot_round_trip_and_pruning(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    views_ = {"source": spark.createDataFrame([("s1", "/a")], "sourceId string, path string"), "media": spark.createDataFrame([("m1", 5)], "mediaId string, size bigint")}
    assert log.snapshot_pointer(spark, folder) is None
    names = [log.write_snapshot(spark, folder, views_, seq, 100 * seq, token) for seq, token in ((1, "a"), (2, "b"), (3, "c"))]
    assert log.snapshot_pointer(spark, folder)["snapshotFile"] == names[2]
    assert [tuple(r) for r in log.read_snapshot(spark, folder, "media", "mediaId string, size bigint").collect()] == [("m1", 5)]
    assert log.prune_snapshots(spark, folder, 0) == names[:2]
    kept = log.retained(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, mtime int"), "b", 1)
    assert sorted(r["name"] for r in kept.collect()) == ["b", "c"]


def test_listing(spark, tmp_path):
    for name in ("a.jpg", "sub/b.jpg", "sub/deep/c.tmp", "private/d.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("xy")
    names = lambda recursive, globs: sorted(r["path"] for r in log.listing(spark, str(tmp_path), recursive, globs).collect())
    assert names(True, []) == ["a.jpg", "private/d.jpg", "sub/b.jpg", "sub/deep/c.tmp"]
    assert names(True, ["private", "**.tmp"]) == ["a.jpg", "sub/b.jpg"]
    assert names(False, []) == ["a.jpg"]
