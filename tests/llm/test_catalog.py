"""The queries with a DuckDB text against it, on the smallest tables."""

import os

import duckdb
import pytest

from waytrace.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got, wanted = catalog.QUERIES[name](spark, DATA), con.sql(catalog.ORACLES[name])
    at = [wanted.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=repr)
