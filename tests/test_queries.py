"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import duckdb
import pytest
from hitflow.plans.queries import ORACLE, QUERIES

TABLES = ["lineitem", "orders", "events"]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    got = QUERIES[name](spark, sf)
    found = [tuple(r) for r in got.collect()]
    if name in ORACLE:
        want = con.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, found) == rows(columns, want.fetchall())
    assert found
