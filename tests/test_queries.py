"""Every registered query against its DuckDB text on the smallest tables."""

import os

import duckdb
import pytest

from waytrace.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    wanted = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in got.columns]
    rows = plain(tuple(r) for r in got.collect())
    assert rows == plain(tuple(r[i] for i in at) for r in wanted.fetchall())
    assert rows or name == "time_gaps"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_plans(spark):
    plan = registry.QUERIES["nearest_road"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    assert "CartesianProduct" not in plan
    assert "cx" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["trip_id", "sec", "dark", "route_id", "cardinal", "extras"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
