"""Executors need no copy of the package."""

import harness

from skeinlake import data_queries


def test_workers_without_the_package(spark, tmp_path):
    names = ["p1_found", "p3_found", "p5_found"]
    got = harness.isolated("skeinlake.data_queries", names, harness.FOLDER, tmp_path)
    for name in names:
        assert got[name] == harness.as_json(data_queries.QUERIES[name](spark, harness.FOLDER)) != []
