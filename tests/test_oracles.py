import harness
import pytest

from skeinlake import catalog_queries, data_queries

CORE = {n: (m.QUERIES[n], m.ORACLES.get(n)) for m in (data_queries, catalog_queries) for n in m.QUERIES}


@pytest.mark.parametrize("name", sorted(n for n in CORE if CORE[n][1]))
def test_query_equals_sql(spark, name):
    _, extra, missing = harness.compare(spark, harness.FOLDER, *CORE[name])
    assert not extra and not missing


@pytest.mark.parametrize("name", sorted(n for n in CORE if not CORE[n][1]))
def test_query_without_sql_runs(spark, name):
    assert CORE[name][0](spark, harness.FOLDER).count() > 0
