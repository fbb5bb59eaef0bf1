"""The text queries that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidewatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, rows))
