"""Every registered raster query runs, and equals its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridlake.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    assert _rows(got, df.columns) == _rows(want.fetchall(), want.columns)


def test_boundary_order(spark):
    counts = {b: {(r.xi, r.yi) for r in catalogue.queries()[b](spark, DATA).filter("mask").collect()} for b in ("inside", "boolmask_polygons", "touches")}
    assert counts["inside"] <= counts["boolmask_polygons"] <= counts["touches"]


def test_plans_have_no_cartesian_product(spark):
    for name, query in catalogue.queries().items():
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
