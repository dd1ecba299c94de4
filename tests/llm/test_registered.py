"""The registered queries on the small tables; where SQL expresses one, against DuckDB."""

import pytest
from compare import compare, duckdb_connection

from auditlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    ok, message = compare(name, spark, duckdb_connection(SF), SF, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok, message
