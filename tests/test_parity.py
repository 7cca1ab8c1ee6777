import os

import duckdb
import pytest

from sluice.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return c


def norm(v):
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, D), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    b = sorted(repr(tuple(norm(r[i]) for i in at)) for r in want.fetchall())
    assert a == b


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
