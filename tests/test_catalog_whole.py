"""Catalog queries over rows that the first versions leave out."""

import harness

from skeinlake import catalog_queries


def near_folder(spark, folder):
    """Media by their entries' states: a, b, c share a head and have no hash, d has no entry, e and f have near hashes."""
    rows = {"a": "active", "b": "active", "c": "missing", "d": None, "e": "active", "f": "deleted"}
    hashes = {"e": "abcdef0000000000", "f": "abcdef0000000001"}
    tables = {
        "media": ([(m, m, 1, "e" + m) for m in rows], "mediaId string, sha256 string, size bigint, sourceEntryId string"),
        "media_metadata": ([(m, 1.0, '{"perceptualHash": "%s"}' % h) for m, h in hashes.items()] + [("b", 1.0, "{}")], "mediaId string, extractedAt double, raw string"),
        "entry_snapshot": ([(6, "e" + m, "s", m, 1, 1.0, s, f"7:1:{'head' if m in 'abcd' else m}", 1.0) for m, s in rows.items() if s], "snapshotNo int, sourceEntryId string, sourceId string, path string, size bigint, mtimeMs double, state string, fingerprint string, lastSeenAt double"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_near_duplicates_of_all_media(spark, tmp_path):
    folder = near_folder(spark, tmp_path)
    pairs, classified = (catalog_queries.QUERIES[n] for n in ("near_dup_pairs_all", "near_dup_classified_all"))
    assert {tuple(r) for r in pairs(spark, folder).collect()} == {("a", "b", None), ("b", "a", None), ("c", "a", None), ("c", "b", None), ("f", "e", 1)}
    want = {"a": ("quarantine", None, None, "a,b"), "b": ("quarantine", None, None, "b,a"), "c": ("quarantine", None, None, "c,a,b"), "f": ("strong", "e", 1, None)}
    assert {r[0]: tuple(r[1:]) for r in classified(spark, folder).collect()} == want
    for name in ("near_dup_pairs_all", "near_dup_classified_all"):
        _, extra, missing = harness.compare(spark, folder, catalog_queries.QUERIES[name], catalog_queries.ORACLES[name])
        assert not extra and not missing


def test_scan_diff_of_archive_entries(spark, tmp_path):
    schema = "snapshotNo int, sourceEntryId string, sourceId string, path string, archivePath string, innerPath string, size bigint, mtimeMs double, state string, fingerprint string, lastSeenAt double"
    inside = lambda snapshot, name, size, state="active": (snapshot, f"e{name}", "s", None, "a.zip", name, size, 1.0, state, "f", 1.0)
    rows = [inside(5, "same", 1), inside(5, "grown", 1), inside(5, "lost", 1), inside(5, "gone", 1, "missing"), inside(6, "same", 1), inside(6, "grown", 2), inside(6, "more", 1)]
    rows += [(n, "ef", "s", "a.zip", None, None, 9, 1.0, "active", "f", 1.0) for n in (5, 6)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/entry_snapshot.parquet")
    query = catalog_queries.QUERIES["scan_diff_all"]
    at = "s:archive:a.zip::"
    want = {(at + "same", "esame", "unchanged"), (at + "grown", "egrown", "changed"), (at + "lost", "elost", "missing"), (at + "more", None, "new"), ("s:file:a.zip", "ef", "unchanged")}
    assert {tuple(r) for r in query(spark, str(tmp_path)).collect()} == want
    _, extra, missing = harness.compare(spark, str(tmp_path), query, catalog_queries.ORACLES["scan_diff_all"])
    assert not extra and not missing
