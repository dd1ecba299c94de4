"""Every registered query against its SQL in DuckDB, and the entry point."""

import pytest

import __spark_entry__ as entry
from auditlake.plans.registry import ALL
from compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(name, spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_query_has_sql():
    assert set(ALL) <= set(entry.queries()) and set(ALL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "weighted_score" in df.columns
