"""Corpus queries against their SQL on the smallest tables; p2_found is compared with brute force elsewhere."""

import harness
import pytest

from skeinlake.llm import queries


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"p2_found"}))
def test_query_equals_sql(spark, name):
    # With a hundred documents, whole documents can't meet shares to a hundredth.
    folder = "/root/testdata/sf0.01" if name == "p8_balance" else harness.FOLDER
    rows, extra, missing = harness.compare(spark, folder, queries.QUERIES[name], queries.ORACLES[name])
    assert rows and not extra and not missing
