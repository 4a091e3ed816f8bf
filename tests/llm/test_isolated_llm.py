"""Executors need no copy of the package."""

import json

import brute
import harness

from skeinlake.llm import queries
from skeinlake.sources.tables import table


def test_workers_without_the_package(spark, tmp_path):
    names = ["p2_found", "p4_found", "p6_found", "p7_found", "p7_removed", "p8_shares", "p9_found"]
    got = harness.isolated("skeinlake.llm.queries", names, harness.FOLDER, tmp_path)
    rows = lambda name: [r.asDict(recursive=True) for r in table(spark, harness.FOLDER, name).collect()]
    repeated = brute.p2(rows("media"), rows("media_metadata"))
    assert {(r["mediaIdA"], r["mediaIdB"], r["matchKind"]) for r in map(json.loads, got.pop("p2_found"))} == repeated
    for name, own in got.items():
        assert own == harness.as_json(queries.QUERIES[name](spark, harness.FOLDER)) != []
