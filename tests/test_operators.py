"""Operators on small tables with known results."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from waytrace.functions import scalar
from waytrace.operators import intervals, matching, memo, resample, roads_prep, spatial, track

KEY = ["trip_id", "sec"]


def fixes(spark, rows):
    """(sec, valid, lat, lon, speed, minute)"""
    start = dt.datetime(2022, 5, 23, 10)
    full = [(1, i, float(s), v, la, lo, float(sp), 0.0, start + dt.timedelta(minutes=m), "c") for i, (s, v, la, lo, sp, m) in enumerate(rows)]
    return spark.createDataFrame(full, "trip_id long, row_seq long, global_sec double, valid boolean, lat double, lon double, speed_mph double, heading double, ts timestamp_ntz, clip string")


def totals(spark, n):
    return spark.createDataFrame([(1, n)], "trip_id long, total_secs int")


def spans(spark, rows, names="start_sec double, end_sec double, label string"):
    return spark.createDataFrame([(1, *r) for r in rows], f"trip_id long, {names}")


def ordered(df, *columns):
    return [tuple(r) for r in df.orderBy(*columns).select(*columns).collect()]


def test_fill(spark):
    rows = fixes(spark, [(0, True, 1.0, 1.0, 1, 0), (1, False, 9.0, 9.0, 1, 1), (2, True, 2.0, 2.0, 1, 2)])
    assert [r[1] for r in ordered(resample.positions_per_second(rows, totals(spark, 4)), "sec", "lat", "lon")] == [1.0, 1.0, 2.0, 2.0]


def test_fill_backwards_and_collisions(spark):
    rows = fixes(spark, [(2, True, 1.0, 1.0, 1, 0), (2, True, 5.0, 5.0, 1, 0), (9, True, 7.0, 7.0, 1, 1)])
    assert [r[1] for r in ordered(resample.positions_per_second(rows, totals(spark, 4)), "sec", "lat")] == [5.0] * 4


def test_fill_from_beyond_the_spine(spark):
    rows = fixes(spark, [(9, True, 7.0, 7.0, 1, 1)])
    assert [r[1] for r in ordered(resample.positions_per_second(rows, totals(spark, 2)), "sec", "lat")] == [7.0] * 2


def test_total_seconds(spark):
    rows = fixes(spark, [(4, True, 1.0, 1.0, 1, 0)])
    assert resample.total_seconds(rows).first().total_secs == 5
    assert resample.total_seconds(rows, spark.createDataFrame([(1, 7.2)], "trip_id long, duration_sec double")).first().total_secs == 8


def test_time_gaps(spark):
    found = track.time_gaps(fixes(spark, [(0, True, 1.0, 1.0, 1, 0), (1, True, 1.0, 1.0, 1, 90), (2, False, 1.0, 1.0, 1, 95), (3, True, 1.0, 1.0, 1, 100)])).collect()
    assert [r.gap_minutes for r in found] == [90.0, 10.0]


def test_average_speed_chain(spark):
    rows = fixes(spark, [(0, True, 36.0, -83.0, 40, 0), (1, False, 36.0, -83.0, 0, 1), (2, True, 36.0, -83.0, 40, 2), (3, True, 36.001, -83.0, 53.5, 3)])
    speeds = [r[1] for r in ordered(track.average_speeds(rows), "row_seq", "average_mph")]
    assert speeds[:3] == [40, 0, 40]
    assert 0 < speeds[3] < 10


def test_odometer_skips_void(spark):
    rows = fixes(spark, [(0, True, 36.0, -83.0, 1, 0), (1, False, 50.0, -83.0, 1, 1), (2, True, 37.0, -83.0, 1, 2)])
    got = ordered(track.odometer(rows), "row_seq", "miles", "remaining")
    assert [round(m, 1) for _, m, _ in got] == [0.0, 0.0, 69.1]
    assert [round(m, 1) for *_, m in got] == [69.1, 69.1, 0.0]


def places(*codes):
    return [(None if c is None else {"name": f"P{i}", "admin1": "Texas", "cc": c}) for i, c in enumerate(codes)]


@pytest.mark.parametrize(("codes", "towns"), [(("US", "MX", "MX", "US"), ["P0", "P0", "P0", "P3"]), (("MX", "US"), ["", "P1"]), (("US", None, "MX"), ["P0", "", "P0"])])
def test_towns(spark, codes, towns):
    rows = spark.createDataFrame([(1, i, float(i), p) for i, p in enumerate(places(*codes))], "trip_id long, row_seq long, global_sec double, place struct<name:string,admin1:string,cc:string>")
    got = track.town_labels(track.resolved_towns(rows)).orderBy("row_seq").collect()
    assert [r.town for r in got] == towns
    assert got[-1].label in ("P3, TX", "P1, TX", "P0, TX")


@pytest.mark.parametrize(("labels", "end", "wanted"), [(["A", "A", "B", "B"], 4, [(0, 2, "A"), (2, 4, "B")]), (["A", "", "A"], 3, [(0, 1, "A"), (2, 3, "A")]), ([], 3, [])])
def test_run_lengths(spark, labels, end, wanted):
    rows = spark.createDataFrame([(1, float(i), x) for i, x in enumerate(labels)], "trip_id long, sec double, label string")
    ends = spark.createDataFrame([(1, float(end))], "trip_id long, end_sec double")
    assert ordered(intervals.run_lengths(rows, ends), "start_sec", "end_sec", "label") == wanted


def test_run_lengths_expand_back(spark):
    rng = random.Random(3)
    labels = [rng.choice(["", "A", "B"]) for _ in range(80)]
    rows = spark.createDataFrame([(1, float(i), x) for i, x in enumerate(labels)], "trip_id long, sec double, label string")
    found = intervals.run_lengths(rows, spark.createDataFrame([(1, 80.0)], "trip_id long, end_sec double")).collect()
    again = [""] * 80
    for r in found:
        again[int(r.start_sec) : int(r.end_sec)] = [r.label] * int(r.end_sec - r.start_sec)
    assert again == labels


@pytest.mark.parametrize(
    ("dark", "fill", "wanted"),
    [
        ([(4.0, 6.0)], "X", [(0, 4, "A"), (4, 6, "X"), (6, 10, "A")]),
        ([(4.0, 6.0)], None, [(0, 4, "A"), (6, 10, "A")]),
        ([], "X", [(0, 10, "A")]),
        ([(-1.0, 2.0), (1.0, 3.0), (9.0, 12.0)], "X", [(0, 2, "X"), (2, 3, "X"), (3, 9, "A"), (9, 10, "X")]),
        ([(2.0, 3.0), (3.0, 4.0)], "X", [(0, 2, "A"), (2, 3, "X"), (3, 4, "X"), (4, 10, "A")]),
        ([(-1.0, 20.0)], None, []),
    ],
)
def test_subtract(spark, dark, fill, wanted):
    found = intervals.subtract(spans(spark, [(0.0, 10.0, "A")]), spans(spark, dark, "start_sec double, end_sec double"), fill)
    assert ordered(found, "start_sec", "end_sec", "label") == wanted


def test_subtract_keeps_length(spark):
    rng = random.Random(5)
    rows = [(float(a), float(a + rng.randint(1, 9)), f"L{a}") for a in range(0, 60, 7)]
    dark = [(a, a + rng.random() * 6) for a in (rng.random() * 60 for _ in range(9))]
    found = intervals.subtract(spans(spark, rows), spans(spark, dark, "start_sec double, end_sec double"), "X").collect()
    assert abs(sum(r.end_sec - r.start_sec for r in found) - sum(b - a for a, b, _ in rows)) < 1e-9


def test_dark_mask(spark):
    whole = totals(spark, 6)
    found = intervals.dark_mask(resample.spine(whole), spans(spark, [(2.5, 4.2)], "start_sec double, end_sec double"), whole)
    assert [d for _, d in ordered(found, "sec", "dark")] == [False, False, True, True, True, False]


def test_day_segments(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate(["d1", "d2", "d1", "d2"])], "trip_id long, sec int, local_date string")
    found = intervals.day_segments(rows)
    assert ordered(found, "day_number", "start_sec", "end_sec") == [(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]


def test_day_titles_use_up_numbers(spark):
    days = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 6), (1, 3, 6, 20)], "trip_id long, day_number long, start_sec int, end_sec int")
    named = spans(spark, [(0.0, 3.0, "A"), (3.0, 6.0, "B"), (6.0, 7.0, ""), (7.0, 9.0, "C")])
    assert ordered(intervals.day_titles(days, named), "start_sec", "end_sec", "title") == [(1.0, 3.0, "Day 2 - A to B"), (6.0, 8.0, "Day 3 - C to C")]


def test_fades(spark):
    match = spark.createDataFrame([(1, i, r) for i, r in enumerate(["I", "I", "I", None, None, None])], "trip_id long, sec int, route_id string")
    assert [a for _, a in ordered(intervals.shield_alpha(match, 2), "sec", "alpha")] == [0.5, 1, 1, 0.5, 0, 0]
    days = spark.createDataFrame([(1, i, 1 + i // 6) for i in range(18)], "trip_id long, sec int, day_number long")
    alphas = [a for _, a in ordered(intervals.segment_fade(days, 2), "sec", "alpha")]
    assert alphas[6:12] == [0, 0.5, 1, 1, 0.5, 0]
    assert alphas[:4] == [1] * 4
    assert set(r.alpha for r in intervals.segment_fade(days, 0).collect()) == {1.0}


def test_debounce(spark):
    rows = spark.createDataFrame([(1, i, float(h)) for i, h in enumerate([90, 135, 180, 225, 225, 225])], "trip_id long, sec int, heading double")
    assert [o for _, o in ordered(matching.debounced_octants(rows, hold=2), "sec", "octant")] == ["E", "E", "E", "SW", "SW", "SW"]


LINE = [(35.0, -100.0 + 0.1 * i) for i in range(11)]


def road_table(spark, rows):
    return spark.createDataFrame([(i, r, k, [{"lat": a, "lon": b} for a, b in g]) for i, (r, k, g) in enumerate(rows)], "road_seq long, route_id string, route_type string, geometry array<struct<lat:double,lon:double>>")


def drive(spark, lats, speeds=None):
    rows = [(1, i, la, -99.5, 90.0, float((speeds or [50] * len(lats))[i])) for i, la in enumerate(lats)]
    return spark.createDataFrame(rows, "trip_id long, sec int, lat double, lon double, heading double, speed_mph double")


def test_hysteresis(spark):
    lats = [35.0, 35.0, 35.1, 35.0, 35.1, 35.1, 35.1, 35.0]
    found = matching.match_roads(drive(spark, lats), road_table(spark, [("I-40", "interstate", LINE)]), grace=2)
    assert ordered(found, "sec", "route_id", "cardinal") == [(i, None if i == 6 else "I-40", None if i == 6 else "E") for i in range(8)]


def test_freeze(spark):
    lats = [35.0, 35.0, 35.1, 35.1, 35.1, 35.1]
    found = matching.match_roads(drive(spark, lats, [50, 50, 0, 0, 0, 0]), road_table(spark, [("I-40", "interstate", LINE)]), grace=0)
    assert [r for _, r in ordered(found, "sec", "route_id")] == ["I-40"] * 6


def test_tiers_and_extras(spark):
    near, far = [(a + 1e-5, b) for a, b in LINE], [(a + 2e-4, b) for a, b in LINE]
    roads = road_table(spark, [("US 70", "us_route", near), ("I-40", "interstate", far), ("I-10", "interstate", LINE)])
    points = drive(spark, [35.0])
    assert spatial.nearest_road(points, roads, 0.031, KEY).first().route_id == "I-10"
    only = spatial.candidates(points, roads.where("route_id <> 'I-10'"), 0.031, KEY)
    assert spatial.nearest(only, KEY).first().route_id == "I-40"
    found = spatial.candidates(points, roads, 0.031, KEY)
    current = points.select(*KEY, F.lit("I-10").alias("route_id"))
    assert spatial.concurrent_roads(found, current, KEY, 2).first().extras == ["I-40", "US 70"]
    nothing = points.select(*KEY, F.lit(None).cast("string").alias("route_id"))
    assert spatial.concurrent_roads(found, nothing, KEY, 5).first().extras == ["I-10", "I-40", "US 70"]


def test_grid_equals_theta(spark):
    rng = random.Random(11)
    lines = []
    for i in range(40):
        lat, lon = 34 + rng.random() * 3, -101 + rng.random() * 3
        line = [(lat, lon)]
        for _ in range(rng.randint(1, 5)):
            line.append((line[-1][0] + rng.uniform(-0.2, 0.2), line[-1][1] + rng.uniform(-0.2, 0.2)))
        lines.append((f"R{i}", rng.choice(["interstate", "us_route", "local"]), line))
    points = spark.createDataFrame([(1, i, 34 + rng.random() * 3, -101 + rng.random() * 3) for i in range(400)], "trip_id long, sec int, lat double, lon double")
    roads = road_table(spark, lines)
    for tolerance in (0.3, 2.5):
        grid = ordered(spatial.nearest_road(points, roads, tolerance, KEY), "sec", "route_id", "nearest_any_mi")
        theta = ordered(spatial.nearest_road_theta(points, roads, tolerance, KEY), "sec", "route_id", "nearest_any_mi")
        assert [g[:2] for g in grid] == [t[:2] for t in theta]
        assert all((g[2] is None) == (t[2] is None) and (g[2] is None or abs(g[2] - t[2]) < 1e-9) for g, t in zip(grid, theta, strict=True))
        assert any(g[1] for g in grid)


def test_a_route_of_two_types(spark):
    at = lambda miles: [(35.0 + miles / 69.172, b) for _, b in LINE]
    roads = road_table(spark, [("US 70", "us_route", at(0.028)), ("US 70", "local", at(0.0007)), ("US 80", "us_route", at(0.014))])
    points = drive(spark, [35.0])
    grid, theta = (f(points, roads, 0.031, KEY).first() for f in (spatial.nearest_road, spatial.nearest_road_theta))
    assert grid.route_id == theta.route_id == "US 80"
    assert abs(grid.nearest_any_mi - 0.0007) < 1e-9
    found = spatial.candidates(points, roads, 0.031, KEY)
    nothing = points.select(*KEY, F.lit(None).cast("string").alias("route_id"))
    assert spatial.concurrent_roads(found, nothing, KEY, 5).first().extras == ["US 80", "US 70"]


def test_nearest_places(spark):
    rng = random.Random(3)
    towns = [(30 + rng.random() * 15, -110 + rng.random() * 20, f"t{i}", "Texas", "US") for i in range(150)]
    places = spark.createDataFrame(towns, "lat double, lon double, name string, admin1 string, cc string")
    asked = [(i, 28 + rng.random() * 19, -112 + rng.random() * 24) for i in range(200)] + [(200, towns[0][0], towns[0][1]), (201, -40.0, 100.0)]
    points = spark.createDataFrame(asked, "id long, lat double, lon double")
    got = {r.id: r.place and r.place.name for r in spatial.nearest_places(points, places).collect()}
    far = lambda p, t: 2 * 3958.76 * math.asin(math.sqrt(math.sin(math.radians(t[0] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(t[0])) * math.sin(math.radians(t[1] - p[2]) / 2) ** 2))
    assert got == {p[0]: min(towns, key=lambda t: far(p, t))[2] for p in asked[:-1]} | {201: None}


def test_spans_and_dark_spans_without_length(spark):
    span = "trip_id long, start_sec double, end_sec double, label string"
    spans = spark.createDataFrame([(1, 0.0, 10.0, "A"), (1, 0.0, 10.0, "A"), (1, 20.0, 20.0, "none"), (2, 5.0, 5.0, "kept"), (1, 1000.0, 3000.0, "long")], span)
    dark = spark.createDataFrame([(1, 4.0, 4.0), (1, 2000.0, 2500.0), (1, 2400.0, 2400.0)], "trip_id long, start_sec double, end_sec double")
    pairs = lambda fill: sorted((r.trip_id, r.start_sec, r.end_sec, r.label) for r in intervals.subtract(spans, dark, fill).collect())
    bare = [(1, 0.0, 4.0, "A")] * 2 + [(1, 4.0, 10.0, "A")] * 2 + [(1, 1000.0, 2000.0, "long"), (1, 2500.0, 3000.0, "long"), (2, 5.0, 5.0, "kept")]
    assert pairs(None) == sorted(bare)
    assert pairs("-") == sorted([*bare, (1, 4.0, 4.0, "-"), (1, 4.0, 4.0, "-"), (1, 2000.0, 2500.0, "-")])


def test_distance_to_route(spark):
    points = drive(spark, [35.01, 35.0]).withColumn("route_id", F.when(F.col("sec") == 0, "I-40").otherwise("gone"))
    got = ordered(spatial.distance_to_route(points, road_table(spark, [("I-40", "interstate", LINE)]), KEY), "sec", "hold_mi")
    assert abs(got[0][1] - 0.69172) < 1e-9
    assert got[1][1] == float("inf")


def test_compass_holds_when_stopped(spark):
    rows = spark.createDataFrame([(1, i, float(h), float(v)) for i, (h, v) in enumerate([(350, 50), (10, 50), (90, 0), (200, 0)])], "trip_id long, sec int, heading double, speed_mph double")
    got = ordered(matching.compass(rows, 1), "sec", "shown")
    assert [round(x) for _, x in got] == [350, 10, 10, 10]


def test_merge_takes_whole_pairs(spark):
    schema = "trip_id long, sec int, route_id string, cardinal string"
    a = spark.createDataFrame([(1, 0, "I-40", None), (1, 1, None, None), (1, 2, "", "N")], schema)
    b = spark.createDataFrame([(1, 0, "Elm", "S"), (1, 1, "Elm", "S"), (1, 2, "Elm", "S")], schema)
    assert ordered(matching.merged_matches(a, b), "sec", "route_id", "cardinal") == [(0, "I-40", None), (1, "Elm", "S"), (2, "Elm", "S")]


def test_thinning_and_labels(spark):
    cities = spark.createDataFrame([(1, "Big", "TX", 35.0, -99.5), (2, "Near", "TX", 35.1, -99.5), (3, "Far", "TX", 35.0, -98.0), (4, "Off", "TX", 39.0, -99.0)], "rank int, name string, state string, lat double, lon double")
    route = spark.createDataFrame([(1, i, 35.0, -100.0 + 0.5 * i) for i in range(5)], "trip_id long, ord long, lat double, lon double")
    near = spatial.cities_on_route(cities, route, 30.0)
    assert [n for n, in ordered(near, "name")] == ["Big", "Far", "Near"]
    thin = spatial.thinned_cities(near, 30.0)
    assert ordered(thin, "rank", "name") == [(1, "Big"), (3, "Far")]
    bounds = spark.createDataFrame([(1, 34.5, 35.5, -100.0, -97.9)], "trip_id long, min_lat double, max_lat double, min_lon double, max_lon double")
    got = ordered(matching.place_labels(thin, bounds, 300, 200, 10.0), "rank", "dx_pt", "dy_pt")
    assert got[0][1:] == (6 * 0.72, 17 * 0.72)
    assert got[1][1] < 0


def test_road_preparation(spark):
    point = lambda a, b: {"lat": a, "lon": b}
    rows = [("I- 40", "I", "S1100", [point(35.0, -99.0), point(35.1, -99.0), point(60.0, -99.0), point(60.1, -99.0)], [0, 2]), ("Elm St ", "M", "S1400", [point(35.0, -99.0), point(35.1, -99.0)], [0]), (None, "U", "S1400", [point(35.0, -99.0), point(35.1, -99.0)], [0])]
    shapes = spark.createDataFrame(rows, "FULLNAME string, RTTYP string, MTFCC string, points array<struct<lat:double,lon:double>>, parts array<int>")
    box = F.struct(F.lit(34.0).alias("min_lat"), F.lit(36.0).alias("max_lat"), F.lit(-100.0).alias("min_lon"), F.lit(-98.0).alias("max_lon"))
    assert [(r.route_id, r.route_type, len(r.geometry)) for r in roads_prep.highway_roads(shapes, box).collect()] == [("I-40", "interstate", 2)]
    assert [r.route_id for r in roads_prep.local_roads(shapes, box).collect()] == ["Elm St"]
    rows = fixes(spark, [(0, True, 35.0, -99.0, 1, 0)]).withColumn("state", F.lit("ZZ"))
    assert [r.state for r in roads_prep.unknown_states(rows).collect()] == ["ZZ"]
    assert roads_prep.state_boxes(rows).count() == 0
    counties = spark.createDataFrame([("001", 34.5, 35.5, -99.5, -98.5), ("002", 36.0, 37.0, -99.5, -98.5)], "county_code string, min_lat double, max_lat double, min_lon double, max_lon double")
    assert [r.county_code for r in roads_prep.counties_of(rows, counties).collect()] == ["001"]


def test_sample_and_downsample(spark):
    rows = fixes(spark, [(i, True, 1.0, 1.0, 1, i) for i in range(10)])
    assert [s for s, in ordered(track.systematic_sample(rows, 3), "row_seq")] == [0, 3, 6, 9]
    seconds = spark.createDataFrame([(1, i, 1.0, 1.0) for i in range(10)], "trip_id long, sec int, lat double, lon double")
    assert [s for _, s in ordered(track.downsampled_route(seconds, 5), "ord", "sec")] == [0, 2, 4, 6, 8, 9]


def test_clip_clock(spark):
    manifest = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0), (1, "c", 2.5)], "trip_id long, clip string, duration_sec double")
    offsets = track.clip_offsets(manifest)
    assert ordered(offsets, "clip", "offset_sec") == [("a", 0.0), ("b", 10.0), ("c", 15.0)]
    raw = spark.createDataFrame([(1, "a", 3), (1, "c", 1), (1, "gone", 1)], "trip_id long, clip string, sec_in_clip int")
    assert ordered(track.on_video_clock(raw, offsets), "global_sec") == [(3.0,), (16.0,)]
    assert ordered(track.dark_spans(offsets, raw), "start_sec", "end_sec", "clip") == [(10.0, 15.0, "b")]
    assert track.total_duration(manifest).first().duration_sec == 17.5


def test_memo(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert memo.kept_table(spark, str(tmp_path / "t"), "k", make).count() == 3
    assert len(made) == 1
    points = spark.createDataFrame([(1.0, 2.0), (1.000001, 2.0), (3.0, 4.0)], "lat double, lon double")
    counts = []

    def measure(new):
        counts.append(new.count())
        return new.withColumn("mi", scalar.haversine_miles(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0)))

    assert memo.kept_points(points.limit(1), str(tmp_path / "p"), "k", measure).count() == 1
    assert memo.kept_points(points, str(tmp_path / "p"), "k", measure).count() == 2
    assert counts == [1, 1]
    spark.range(5).selectExpr("cast(id as string) v").coalesce(1).write.text(str(tmp_path / "x"))
    assert memo.content_digest(spark, str(tmp_path / "x")) == memo.content_digest(spark, str(tmp_path / "x"))
    assert memo.match_key("a", "b", 0.1, 3, 10, 3.0) != memo.match_key("a", "b", 0.1, 2, 10, 3.0)
