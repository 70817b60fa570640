"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans.queries import ORACLES, QUERIES


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else f"{v:.9g}")
    return (1, str(v))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(small):
        c.sql(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        r = duck.sql(ORACLES[name])
        order = [r.columns.index(c) for c in sorted(r.columns)]
        assert sorted(r.columns) == cols
        assert rows == sorted(tuple(cell(x[i]) for i in order) for x in r.fetchall())
    else:
        assert rows
