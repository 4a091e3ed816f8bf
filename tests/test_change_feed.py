import json
import random

import pytest

from skeinlake.operators import change_feed, views
from skeinlake.operators.change_feed import EntryTable, entry_events, replay
from skeinlake.plans.staging import Workspace, publish_text, read_text
from skeinlake.streaming.views import maintain_entries

LOG = "seq bigint, event struct<eventId string, type string, createdAt double, jobId string, payload string>, u string, row int"


def history(seed, n, keys=8, sources=3):
    r, out = random.Random(seed), []
    for seq in range(1, n + 1):
        kind = r.choices(["SOURCE_ENTRY_UPSERTED", "SOURCE_ENTRY_MARKED_MISSING", "SOURCE_REMOVED", "JOB_STARTED"], [6, 3, 1, 1])[0]
        key, source = f"se_{r.randrange(keys)}", f"src_{r.randrange(sources)}"
        payload = {
            "SOURCE_ENTRY_UPSERTED": {"entry": {"sourceEntryId": key, "sourceId": source, "fingerprint": f"{seq}", "state": r.choice(["active"] * 5 + ["deleted"]), "lastSeenAt": seq}},
            "SOURCE_ENTRY_MARKED_MISSING": {"sourceEntryId": key, "lastSeenAt": seq},
            "SOURCE_REMOVED": {"sourceId": source},
        }.get(kind, {})
        out.append((seq, (f"e{seq}", kind, float(seq), None, json.dumps(payload)), "x", 1))
    out += [(n + 5 + i, e, "x", 1) for i, (_, e, *_) in enumerate(r.sample(out, n // 8))]  # written again
    out += r.sample(out, n // 8)
    r.shuffle(out)
    return out


def fold(rows, deletes=True):
    seen, state, pos = set(), {}, {}
    for seq, (eid, kind, _, _, payload), *_ in sorted(rows, key=lambda x: x[0]):
        if eid in seen:
            continue
        seen.add(eid)
        p = json.loads(payload)
        if kind == "SOURCE_ENTRY_UPSERTED":
            e = p["entry"]
            if e["state"] == "deleted" and deletes:
                state.pop(e["sourceEntryId"], None)
            else:
                pos.setdefault(e["sourceEntryId"], seq)
                state[e["sourceEntryId"]] = dict(e)
        elif kind == "SOURCE_ENTRY_MARKED_MISSING" and p["sourceEntryId"] in state:
            state[p["sourceEntryId"]].update(state="missing", lastSeenAt=p["lastSeenAt"])
        elif kind == "SOURCE_REMOVED":
            for k in [k for k, v in state.items() if v["sourceId"] == p["sourceId"]]:
                del state[k], pos[k]
    return {(k, v["fingerprint"], v["state"], float(v["lastSeenAt"])) for k, v in state.items()}, {(k, pos[k]) for k in state if k in pos}


def rows_of(df):
    return {tuple(r) for r in df.select("sourceEntryId", "fingerprint", "state", "lastSeenAt").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_fold(spark, seed):
    rows = history(seed, 120)
    assert rows_of(replay(spark.createDataFrame(rows, LOG))) == fold(rows)[0]


def test_view_equals_fold(spark):
    rows = history(7, 150)
    got = views.entries(views.typed(spark.createDataFrame(rows, LOG)))
    want, pos = fold(rows, deletes=False)
    assert rows_of(got) == want
    assert {tuple(r) for r in got.select("sourceEntryId", "pos").collect()} == pos


def test_only_touched_buckets_are_rewritten_and_old_files_go(spark):
    rows = history(4, 80, keys=40)
    table = EntryTable(spark, Workspace(spark, "t").root, buckets=16)
    table.apply(entry_events(spark.createDataFrame(rows, LOG)))
    before = table.manifest()
    one = [(1000, ("x", "SOURCE_ENTRY_UPSERTED", 1.0, None, json.dumps({"entry": {"sourceEntryId": "se_1", "sourceId": "src_9", "fingerprint": "new", "state": "active", "lastSeenAt": 5}})), "x", 1)]
    table.apply(entry_events(spark.createDataFrame(one, LOG)))
    after = table.manifest()
    assert after.version == 2 and sum(before.files.get(b) != g for b, g in after.files.items()) == 1
    want = fold(rows + one)[0]
    assert rows_of(table.current()) == want
    table.vacuum()
    assert rows_of(table.current()) == want


@pytest.mark.parametrize("seed", [5, 6])
def test_batches_in_any_order_and_repeated(spark, seed):
    rows = history(seed, 90)  # with copies under other positions, some of them lower than the event's first
    rows += [(r.randrange(1, 90), e, "x", 1) for r in [random.Random(seed)] for _, e, *_ in r.sample(rows, 25)]
    rows = [(seq * 1000 + i, *rest) for i, (seq, *rest) in enumerate(rows)]
    parts = [rows[i::3] for i in range(3)]
    table = EntryTable(spark, Workspace(spark, "t").root, buckets=4)
    for part in [*parts, parts[1]]:
        table.apply(entry_events(spark.createDataFrame(part, LOG)))
    assert rows_of(table.current()) == fold(rows)[0]


def upsert(seq, event, key, value, source="src_9", state="active"):
    entry = {"sourceEntryId": key, "sourceId": source, "fingerprint": value, "state": state, "lastSeenAt": 5}
    return (seq, (event, "SOURCE_ENTRY_UPSERTED", 1.0, None, json.dumps({"entry": entry})), "x", 1)


def test_a_later_copy_takes_an_event_back(spark):
    table = EntryTable(spark, Workspace(spark, "t").root, buckets=2)
    first = [upsert(50, "x", "k", "of x"), upsert(30, "y", "k", "of y"), upsert(20, "z", "k", "of z")]
    for part, want in ((first, "of x"), ([upsert(10, "x", "k", "of x")], "of y"), ([upsert(5, "y", "k", "of y")], "of z")):
        table.apply(entry_events(spark.createDataFrame(part, LOG)))
        assert rows_of(table.current()) == {("k", want, "active", 5.0)}


def test_a_losing_writer_leaves_the_table_readable(spark):
    rows = history(6, 40)
    table = EntryTable(spark, Workspace(spark, "t").root, buckets=2)
    table.apply(entry_events(spark.createDataFrame(rows[:20], LOG)))
    first = table.manifest()
    table.apply(entry_events(spark.createDataFrame(rows[20:], LOG)))
    late = EntryTable(spark, table.root)
    late.manifest = lambda: first
    with pytest.raises(FileExistsError):
        late.apply(entry_events(spark.createDataFrame([upsert(1000, "late", "se_1", "late")], LOG)))
    assert rows_of(table.current()) == fold(rows)[0]
    table.vacuum()
    assert rows_of(table.current()) == fold(rows)[0]
    table.apply(entry_events(spark.createDataFrame([upsert(1000, "late", "se_1", "late")], LOG)))
    assert ("se_1", "late", "active", 5.0) in rows_of(table.current())


def test_purge_keeps_the_table_and_drops_what_is_settled(spark):
    rows = [r for r in history(9, 120) if r[0] <= 120]
    table = EntryTable(spark, Workspace(spark, "t").root, buckets=4)
    table.apply(entry_events(spark.createDataFrame([r for r in rows if r[0] <= 80], LOG)))
    before = table._rows(table.manifest()).where("row is not null").count()
    table.purge(81)
    assert rows_of(table.current()) == fold([r for r in rows if r[0] <= 80])[0]
    left = table._rows(table.manifest()).where("row is not null").count()
    assert left < before and left <= 8
    table.apply(entry_events(spark.createDataFrame(rows, LOG)))  # all events again, and new ones
    assert rows_of(table.current()) == fold(rows)[0]


def test_a_name_is_published_once(spark, tmp_path):
    publish_text(spark, str(tmp_path / "m.json"), "one")
    with pytest.raises(FileExistsError):
        publish_text(spark, str(tmp_path / "m.json"), "two")
    assert read_text(spark, str(tmp_path / "m.json")) == "one" and not list(tmp_path.glob("*.tmp"))


def test_nulls_and_empty(spark):
    rows = [
        (None, ("a", "SOURCE_ENTRY_UPSERTED", 1.0, None, "{}"), "x", 1), (1, (None, "SOURCE_REMOVED", 1.0, None, "{}"), "x", 1),
        (2, ("b", "SOURCE_ENTRY_UPSERTED", 1.0, None, '{"entry":'), "x", 1), (3, ("c", None, None, None, None), "x", 1), (4, None, "x", 1),
    ]
    assert rows_of(replay(spark.createDataFrame(rows, LOG))) == set()
    assert rows_of(replay(spark.createDataFrame([], LOG))) == set()


def test_stream_equals_batch(spark, tmp_path):
    rows = history(8, 60)
    spark.createDataFrame(rows, LOG).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    table = EntryTable(spark, str(tmp_path / "table"), buckets=4)
    maintain_entries(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert rows_of(table.current()) == fold(rows)[0]
    assert change_feed.power_of_two(5) == 8
