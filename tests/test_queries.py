"""Every query that has SQL, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from itembank.plans import building as _building  # noqa: F401
from itembank.plans import practice as _more  # noqa: F401
from itembank.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: list(map(norm, v)) if isinstance(v, list) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([norm(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, [list(r) for r in got.collect()]) == rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
