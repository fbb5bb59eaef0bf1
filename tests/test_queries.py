"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest
from conftest import DATA

from tidewatch.plans import registry

TABLES = ["events", "lineitem"]


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v + 0.0, 6))
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == normal(want.fetchall(), want.columns)


def test_every_query_but_training_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"trained_tree", "trained_booster", "trained_task"}
