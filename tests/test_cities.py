"""Cities along routes against plain loops, and with many cities and trips against the SQL."""

import math
import os
import random
import threading

import duckdb
import pytest

from waytrace.operators import matching, spatial
from waytrace.plans import registry

DATA = "/root/testdata/sf0.01"
SECONDS = 60  # the old way took 84 s for the query below on eight cores, the present one 3 to 7 s


def by_loops(cities, route, radius, gap):
    """Every leg with every city, in the order of the operator."""
    found = set()
    mi = 69.172
    finite = lambda *v: all(x is not None and math.isfinite(x) for x in v)
    for trip in {r[0] for r in route}:
        points = [r[2:] for r in sorted(r for r in route if r[0] == trip)]
        legs = [(a, tuple(x if y is None else y for x, y in zip(a, b, strict=True))) for a, b in zip(points, [*points[1:], (None, None)], strict=True)]
        legs = [(a, b) for a, b in legs if finite(*a, *b)]
        kept = []
        for city in sorted(c for c in cities if finite(*c[3:])):
            lat, lon = city[3:]
            k = mi * math.cos(math.radians(lat))
            far = math.inf
            for a, b in legs:
                ax, ay, bx, by = (a[1] - lon) * k, (a[0] - lat) * mi, (b[1] - lon) * k, (b[0] - lat) * mi
                square = (bx - ax) ** 2 + (by - ay) ** 2
                t = min(1, max(0, -(ax * (bx - ax) + ay * (by - ay)) / square)) if square else 0
                far = min(far, math.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
            if far <= radius and all(math.hypot((lon - o[4]) * k, (lat - o[3]) * mi) >= gap for o in kept):
                kept.append(city)
        found |= {(trip, *c) for c in kept}
    return found


@pytest.mark.parametrize(("top", "gap"), [(36.0, 15.0), (36.0, 3.0), (89.9, 15.0), (36.0, 0.0)])
def test_selected_cities(spark, top, gap):
    rng = random.Random(f"{top} {gap}")
    place = lambda: (round(rng.uniform(top - 3, top), 2), round(rng.uniform(-101, -97), 2))
    cities = [(rng.randrange(200), f"C{i}", "TX", *place()) for i in range(500)]
    cities += [(rng.randrange(200), f"D{i}", rng.choice(["TX", "OK"]), *rng.choice(cities)[3:]) for i in range(500)]
    cities += [(0, "no", "TX", None, -99.0), (0, "nan", "TX", math.nan, -99.0)]
    route = []
    for trip in range(12):
        lat, lon = place()
        for i in range(rng.choice([1, 2, 40])):
            jump = rng.random() < 0.1
            lat, lon = place() if jump else (lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.05))
            odd = rng.random()
            route.append((trip, i, None if odd < 0.03 else math.nan if odd < 0.06 else lat, lon))
    schema = "rank int, name string, state string, lat double, lon double"
    got = spatial.selected_cities(spark.createDataFrame(cities, schema), spark.createDataFrame(route, "trip_id long, ord long, lat double, lon double"), 12.0, gap)
    rows = [tuple(r) for r in got.select("trip_id", "rank", "name", "state", "lat", "lon").collect()]
    assert len(rows) == len(set(rows))
    assert rows
    assert set(rows) == by_loops(cities, route, 12.0, gap)


def test_small_lists_and_blocks(spark, monkeypatch):
    """A trip over several batches to Python, lists in parts, one place measured at a time."""
    monkeypatch.setattr(spatial, "LIST_ROWS", 3)
    monkeypatch.setattr(spatial, "BLOCK", 1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        test_selected_cities(spark, 36.0, 15.0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["city_thinning", "city_labels"])
def test_many_cities(spark, tmp_path, name):
    """60,000 cities on 150 trips, in bounded time."""
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    con.sql(f"COPY (SELECT * FROM read_parquet('{DATA}/events.parquet')) TO '{tmp_path}/events.parquet'")
    con.sql(f"COPY (SELECT CAST(range AS BIGINT) AS s_suppkey, concat('Supplier#', lpad(CAST(range AS VARCHAR), 9, '0')) AS s_name, 0 AS s_nationkey, 0e0 AS s_acctbal FROM range(60000)) TO '{tmp_path}/supplier.parquet'")
    for table in ("events", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    late = threading.Timer(SECONDS, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = registry.QUERIES[name](spark, str(tmp_path))
        rows = [tuple(r) for r in got.collect()]
    finally:
        late.cancel()
    wanted = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    key = lambda r: r[:2]
    assert sorted(rows, key=key) == sorted(wanted, key=key)


def test_panels_over_batches(spark):
    """Panels that share a batch, and a panel over several, get what each gets by itself."""
    rng = random.Random(5)
    cities = [(trip, rank, f"City {rank}", 34 + rng.random(), -100 + rng.random()) for trip in range(6) for rank in range(rng.choice([1, 4, 30]))]
    cities.append((0, None, "last", 34.5, -99.5))
    schema = "trip_id long, rank int, name string, lat double, lon double"
    bounds = spark.createDataFrame([(trip, 34.0, 35.0, -100.0, -99.0) for trip in range(6)], "trip_id long, min_lat double, max_lat double, min_lon double, max_lon double")

    def placed(rows):
        return sorted(map(tuple, matching.place_labels(spark.createDataFrame(rows, schema), bounds, 320, 240, 9.0).collect()), key=repr)

    alone = sorted((r for trip in range(6) for r in placed([c for c in cities if c[0] == trip])), key=repr)
    assert len(alone) == len(cities)
    assert {r[3] is None for r in alone} == {True, False}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in ("2", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        assert placed(cities) == alone
