"""Every registered query with SQL against DuckDB, and the others for rows; what these hold is tested with small cases elsewhere."""

import pytest
from compare import assert_same, tables

from shoal.plans import evaluate_queries, maintain_queries, search_queries, timeline_queries, vector_queries
from shoal.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
assert all((evaluate_queries, maintain_queries, search_queries, timeline_queries, vector_queries))


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert rows and all(r["timestamp"].startswith("1997") for r in rows) and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
