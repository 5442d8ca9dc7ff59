"""The entry points and the streaming operators from end to end."""

import datetime as dt

from pyspark.sql import functions as F

from waytrace.plans import pipeline
from waytrace.plans.telemetry import chunk
from waytrace.streaming import tracks


def test_extract_and_overlay(spark, tmp_path):
    drive = b"".join(chunk(True, 35.0, -99.0 + s * 1e-3, 50.0, 90.0, s) for s in range(10))
    later = b"".join(chunk(s != 1, 35.0, -98.9 + s * 1e-3, 50.0, 90.0, 20 + s) for s in range(5))
    files = spark.createDataFrame([("a", drive), ("b", b"dark"), ("c", later), ("d", drive)], "clip string, content binary")
    manifest = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0), (1, "c", 5.0)], "trip_id long, clip string, duration_sec double")
    places = spark.createDataFrame([(35.0, round(-99.0 + s * 1e-3, 3), f"P{s // 5}", "Texas", "US") for s in range(120)], "lat double, lon double, name string, admin1 string, cc string")
    out = pipeline.extract(files, manifest, places)
    assert out["track"].count() == 15
    assert [tuple(r) for r in out["gaps"].select("start_sec", "end_sec", "clip").collect()] == [(10.0, 15.0, "b")]
    assert out["durations"].first().duration_sec == 20.0
    labels = [tuple(r) for r in out["labels"].orderBy("start_sec").select("start_sec", "end_sec", "label").collect()]
    assert labels[0] == (0.0, 5.0, "P0, TX")
    assert labels[1] == (5.0, 10.0, "P1, TX")
    assert [r.value for r in out["clip_list"].collect()] == ["file 'a'", "file 'b'", "file 'c'"]

    line = [{"lat": 35.0, "lon": -100.0 + 0.1 * i} for i in range(21)]
    roads = spark.createDataFrame([(0, "I-40", "interstate", line)], "road_seq long, route_id string, route_type string, geometry array<struct<lat:double,lon:double>>")
    kept = (str(tmp_path / "matches"), "track", "roads")
    arguments = (out["track"], out["labels"], out["gaps"], out["durations"])
    shown = pipeline.overlay(*arguments, roads, roads.limit(0), kept=kept)
    strip = {r.sec: r for r in shown["strip"].collect()}
    assert len(strip) == 20
    assert strip[3].route_label == "I-40 EB"
    assert strip[3].octant == "E"
    assert strip[12].route_label is None
    assert strip[12].segments[0].text == "no GPS lock"
    assert shown["coverage"].first().dark_secs == 5
    lines = [r.value for r in shown["events"].collect()]
    assert any("no GPS lock" in x for x in lines)
    assert any("DayTitle" in x and "Day 1 - P0, TX to" in x for x in lines)
    assert shown["seconds"].count() == 20

    # matches that are kept are taken again, whatever roads come along
    again = pipeline.overlay(*arguments, roads.limit(0), roads.limit(0), kept=kept)
    assert again["strip"].where("route_label = 'I-40 EB'").count() == sum(r.route_label == "I-40 EB" for r in strip.values()) > 0
    assert len(list((tmp_path / "matches").iterdir())) == 2


def test_prepare_roads(spark):
    rows = [(1, i, float(i), True, 35.0 + i * 0.01, -99.0, "TX") for i in range(40)]
    fixes = spark.createDataFrame(rows, "trip_id long, row_seq long, global_sec double, valid boolean, lat double, lon double, state string")
    point = lambda a, b: {"lat": a, "lon": b}
    shapes = spark.createDataFrame(
        [("TX", "001", "I", "S1100", "I- 20", [point(35.0, -99.0), point(35.1, -99.0)], [0]), ("TX", "001", "M", "S1400", "Elm", [point(35.0, -99.0), point(35.1, -99.0)], [0]), ("TX", "009", "M", "S1400", "Oak", [point(35.0, -99.0), point(35.1, -99.0)], [0])],
        "state string, county_code string, RTTYP string, MTFCC string, FULLNAME string, points array<struct<lat:double,lon:double>>, parts array<int>",
    )
    counties = spark.createDataFrame([("001", 34.0, 36.0, -100.0, -98.0), ("009", 40.0, 41.0, -100.0, -98.0)], "county_code string, min_lat double, max_lat double, min_lon double, max_lon double")
    out = pipeline.prepare_roads(fixes, shapes, counties)
    assert [r.route_id for r in out["highways"].collect()] == ["I-20"]
    assert [r.route_id for r in out["locals"].collect()] == ["Elm"]
    assert out["boxes"].first().census_code == "48"


def _stream(spark, tmp_path, name):
    start = dt.datetime(2022, 5, 23, 10)
    rows = [(1, start + dt.timedelta(minutes=m), True, 50.0 + m, float(h)) for m, h in ((0, 90), (1, 135), (2, 180), (3, 225), (4, 225), (5, 225), (40, 0), (120, 0))]
    schema = "trip_id long, event_time timestamp, valid boolean, speed_mph double, heading double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def _run(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_sessions(spark, tmp_path):
    got = _run(tracks.sessions(_stream(spark, tmp_path, "s")), "drives").orderBy("start").collect()
    assert [(r.n_fixes, r.top_mph) for r in got][:2] == [(6, 55.0), (1, 90.0)]


def test_stream_windows(spark, tmp_path):
    got = _run(tracks.speed_windows(_stream(spark, tmp_path, "w")), "speeds").orderBy("start").first()
    assert (got.n_fixes, got.mean_mph) == (5, 52.0)


def test_stream_octants(spark, tmp_path):
    got = _run(tracks.debounced_octants(_stream(spark, tmp_path, "o")), "octants").orderBy("event_time").select(F.collect_list("octant")).first()[0]
    assert got[:6] == ["E", "E", "E", "SW", "SW", "SW"]
