"""Survivors with the mixtures of all metadata."""

from skeinlake.llm import survivors


def test_survivors_use_mixtures_of_all_metadata(spark):
    clear = [(f"o{i}", float(i), f"{m:02d}/{d:02d}/2020 10:00:00", None, "cam", 1, "{}") for i, (m, d) in enumerate([(1, 25), (3, 30), (5, 17), (7, 28), (9, 19)] * 4)]
    metadata = spark.createDataFrame([*clear, ("a", 1.0, "02/03/2020 10:00:00", None, "cam", 1, "{}")], "mediaId string, extractedAt double, takenAt string, tzName string, cameraModel string, width int, raw string")
    media = spark.createDataFrame([("a", 5)], "mediaId string, size bigint")
    quarantine = spark.createDataFrame([("q", ["a"])], "quarantineId string, candidateMediaIds array<string>")
    found = {r["fieldName"] for r in survivors.media_survivors(quarantine, media, metadata).collect()}
    assert "takenAt" in found


METADATA = "mediaId string, extractedAt double, takenAt string, kind string, cameraModel string, mimeType string, width int, height int, raw string, grp string, candidate int, extractor string"


def records(spark, quarantine, metadata):
    q = spark.createDataFrame(quarantine, "quarantineId string, candidateMediaIds array<string>, grp int, bundle string")
    m = spark.createDataFrame([(*row, "g", 7, "own") for row in metadata], METADATA)
    return {tuple(r) for r in survivors.consistent_records(q, m).collect()}


def test_records_take_whole_bundles_that_go_together(spark):
    """Extra columns with names the operator uses, repeated rows and ids, nulls and cut raw change nothing."""
    trusted, cut = '{"extractor": "exiftool"}', '{"extractor": "exif'
    metadata = [
        ("a", 1.0, "t", "photo", "Cam A", "image/png", 10, 10, trusted), ("a", 1.0, "t", "photo", "Cam A", "image/png", 10, 10, trusted),
        ("b", 9.0, None, "video", "Cam B", "video/mp4", 50, 50, cut), ("c", 5.0, " ", None, None, None, None, 9, None),
    ]
    quarantine = [("q", ["b", " a ", "b", None, "", "zz"], 1, "x"), ("q", ["c"], 2, "y"), ("none", None, 1, "x"), (None, ["a"], 1, "x"), ("unknown", ["zz"], 1, "x")]
    got = records(spark, quarantine, metadata)
    # The larger picture is b's, but the trusted camera goes with its own; one of both gives way, the first in order keeping its rank.
    camera, picture = ({m for _, b, m in got if b == n} for n in ("camera", "picture"))
    assert camera == picture == {"a"} and {m for _, b, m in got if b == "kind"} == {m for _, b, m in got if b == "mimeType"} == {"a"}
    assert {m for _, b, m in got if b == "time"} == {"a"} and {q for q, *_ in got} == {"q"}
    assert records(spark, [], metadata) == set() and records(spark, quarantine, []) == set()


def test_search_is_cut_off_by_what_is_left():
    """Many options under dependencies that only fit far down: the forward bound keeps the search short."""
    n = 60
    options = {b: [((i, 0, 0, f"{b}{i}"), f"{b}{i}", {b: str(i)}) for i in range(n)] for b in ("a", "b", "c", "d")}
    rules = [survivors.Dependency("a", "b"), survivors.Dependency("b", "c"), survivors.Dependency("c", "d")]
    pairs = {d: {str(i): {str(n - 1 - i)} for i in range(n)} for d in rules}
    best = survivors.search(options, rules, pairs)
    assert best == {"a": "a0", "b": f"b{n - 1}", "c": "c0", "d": f"d{n - 1}"}
