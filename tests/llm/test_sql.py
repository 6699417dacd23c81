"""Every corpus query with SQL gives the rows that DuckDB gives for that SQL."""

import os

import duckdb
import pytest

from sawmill.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted(repr([r[c] for c in sorted(names)]) for r in found)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(names, r)) for r in want.fetchall())
