"""Readers, exports and settings."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from waytrace import config
from waytrace.plans.telemetry import chunk
from waytrace.sources import clips, files, sinks


def test_scan_of_one_chunk():
    data = b"junk" + chunk(True, 36.213338, -83.258350, 24.6, 271.5, 5) + b"tail"
    (fix,) = clips.fixes_in(data)
    assert fix[0] == 0
    assert fix[1] == "2022-05-23 14:00:05"
    assert fix[2] is True
    assert abs(fix[3] - 36.213338) < 1e-5
    assert abs(fix[4] + 83.258350) < 2e-4
    assert fix[5:] == (24.6, 271.5)


def test_void_counts_and_truncated_goes():
    data = chunk(False, 1.0, 1.0, 0.0, 0.0, 1) + chunk(True, 1.0, 1.0, 0.0, 0.0, 2) + chunk(True, 1.0, 1.0, 0.0, 0.0, 3)[:80]
    assert [(f[0], f[2]) for f in clips.fixes_in(data)] == [(0, False), (1, True)]


def test_knots():
    body = chunk(True, 1.0, 1.0, 21.34 * clips.MPH_PER_KNOT, 0.0, 1)
    assert struct.unpack_from("<4f", body, body.index(b"ANE\0") + 4)[2] == pytest.approx(21.34, abs=1e-5)
    assert next(clips.fixes_in(body))[5] == 24.6


def test_clips_from_a_folder(spark, tmp_path):
    for name in ("b.mp4", "a.MP4", "c.txt"):
        (tmp_path / name).write_bytes(chunk(True, 1.0, 1.0, 5.0, 0.0, 1) * 2)
    (tmp_path / "sub").mkdir()
    found = clips.clip_files(spark, str(tmp_path))
    assert sorted(r.clip for r in found.select("clip").collect()) == ["a.MP4", "b.mp4"]
    assert clips.folder_fixes(spark, str(tmp_path)).count() == 4


def test_clips_in_splits(spark, tmp_path):
    """Split clips with torn, touching and void chunks against a scan of the whole bytes."""
    rnd = random.Random(3)
    for n in range(3):
        data = bytearray(rnd.randbytes(rnd.choice([0, 50, 5000])))
        for sec in range(40):
            one = chunk(rnd.random() < 0.8, 35.0 + sec * 1e-3, -99.0 - sec * 1e-3, 50.0, 90.0, sec)
            data += one[: rnd.randrange(len(one))] if rnd.random() < 0.1 else one
            data += clips.TAG * rnd.choice([0, 0, 1, 2]) + rnd.randbytes(rnd.choice([0, 3, 300, 2000]))
        (tmp_path / f"c+{n} %20x.mp4").write_bytes(data)
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "none.MP4").write_bytes(b"\xff\xfe" * 9000)
    (tmp_path / "other.txt").write_bytes(chunk(True, 1.0, 1.0, 5.0, 0.0, 1))
    wanted = sorted((p.name, *fix) for p in tmp_path.glob("*.[mM]*") for fix in clips.fixes_in(p.read_bytes()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = sorted(tuple(r) for r in clips.folder_fixes(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(wanted) > 90
    assert got == wanted


def test_roads(spark, tmp_path):
    def feature(kind, coordinates, **properties):
        return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}

    line = [[-99.0, 35.0], [-98.0, 36.0]]
    rows = [feature("LineString", line, route_id="I-40"), feature("MultiLineString", [line, line[::-1]], route_id="Elm", route_type="local"), feature("LineString", line), feature("LineString", line[:1], route_id="x"), feature("Point", [1.0, 2.0], route_id="p")]
    path = tmp_path / "roads.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=1))
    got = files.read_roads(spark, str(path)).orderBy("road_seq").collect()
    assert [(r.route_id, r.route_type) for r in got] == [("I-40", "interstate"), ("Elm", "local"), ("Elm", "local")]
    assert tuple(got[0].geometry[0]) == (35.0, -99.0)
    assert [tuple(r.points[0]) for r in files.read_borders(spark, str(path)).orderBy("feature", "part").collect()][:2] == [(-99.0, 35.0), (-99.0, 35.0)]
    assert files.read_borders(spark, str(tmp_path / "none")).count() == 0
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("LineString", [[1.0, 2.0, 3.0]] * 2, route_id="z")]}))
    with pytest.raises(Exception, match="lon, lat"):
        files.read_roads(spark, str(path)).collect()


def test_geojson_round_trip(spark, tmp_path):
    roads = spark.createDataFrame([("I-40", "interstate", [{"lat": 35.0, "lon": -99.0}, {"lat": 36.0, "lon": -98.0}])] * 3, "route_id string, route_type string, geometry array<struct<lat:double,lon:double>>")
    sinks.write_geojson(roads, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    held = json.loads(part.read_text())
    assert len(held["features"]) == 3
    assert files.read_roads(spark, str(part)).count() == 3
    sinks.write_geojson(roads.limit(0), str(tmp_path / "none"))
    (part,) = (tmp_path / "none").glob("part-*")
    assert json.loads(part.read_text())["features"] == []


def test_small_files(spark, tmp_path):
    (tmp_path / "gaps.csv").write_text("start_sec,end_sec,clip\n1.5,2.5,a\n")
    assert [tuple(r) for r in files.read_gaps(spark, str(tmp_path / "gaps.csv")).collect()] == [(1.5, 2.5, "a")]
    assert files.read_gaps(spark, str(tmp_path / "missing.csv")).count() == 0
    (tmp_path / "bad.csv").write_text("start_sec,end_sec,clip\n1.5,2.5,a\nx,y,z\n")
    assert files.read_gaps(spark, str(tmp_path / "bad.csv")).count() == 0
    (tmp_path / "cities.csv").write_text("rank,name,state,lat,lon\n2,B,TX,1,2\n1,A,TX,1,2\n")
    assert [r.name for r in files.read_cities(spark, str(tmp_path / "cities.csv")).collect()] == ["A", "B"]


def test_track_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c", 0, 0.0004, "2022-05-23 10:00:00", True, 1.0, 2.0, 3.0, 4.0, "T", "TX", 5), ("c", 1, 1.0, "2022-05-23 10:00:01", False, 1.0, 2.0, 3.0, 4.0, "", "", 6)], "clip string, sec_in_clip int, global_sec double, timestamp_utc string, valid boolean, lat double, lon double, speed_mph double, heading double, town string, state string, row_seq long")
    sinks.write_track(rows, str(tmp_path / "track"))
    (part,) = (tmp_path / "track").glob("part-*")
    assert part.read_text().splitlines()[0] == "clip,sec_in_clip,global_sec,timestamp_utc,valid,lat,lon,speed_mph,heading,town,state"
    got = files.read_track(spark, str(part)).orderBy("row_seq").collect()
    assert [(r.global_sec, r.valid, str(r.ts)) for r in got] == [(0.0, True, "2022-05-23 10:00:00"), (1.0, False, "2022-05-23 10:00:01")]
    sinks.write_spans(spark.createDataFrame([], "start_sec double, end_sec double, clip string"), str(tmp_path / "gaps"), "clip")
    assert files.read_gaps(spark, str(tmp_path / "gaps")).count() == 0


def test_labels_and_clip_list(spark, tmp_path):
    spans = spark.createDataFrame([(1.23456, 2.0, "A")], "start_sec double, end_sec double, label string")
    sinks.write_spans(spans, str(tmp_path / "labels"))
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "labels")).collect()] == [(1.235, 2.0, "A")]
    kept = spark.createDataFrame([("b'c.mp4",), ("a.mp4",)], "clip string")
    assert [r.value for r in sinks.clip_list(kept).collect()] == ["file 'a.mp4'", "file 'b'\\''c.mp4'"]


def test_subtitles(spark, tmp_path):
    spans = spark.createDataFrame([(1, 0.0, 2.0, "A\nB"), (1, 2.0, 2.05, "short")], "trip_id long, start_sec double, end_sec double, label string")
    titles = spark.createDataFrame([(1, 0.0, 2.0, "Day 1 - A to B"), (1, 5.0, 5.01, "gone")], "trip_id long, start_sec double, end_sec double, title string")
    events = sinks.ass_events(spans, spans.limit(0), titles)
    assert [r.value for r in events.orderBy("stream").collect()] == ["Dialogue: 0,0:00:00.00,0:00:02.00,Town,,0,0,0,,{\\fad(500,500)}A B", "Dialogue: 1,0:00:00.00,0:00:02.00,DayTitle,,0,0,0,,{\\fad(300,300)}Day 1 - A to B"]
    sinks.write_ass(events, str(tmp_path / "ass"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "ass").glob("part-*")))
    assert text.startswith("[Script Info]\n")
    assert text.count("\nStyle: ") == 3
    assert text.rstrip().endswith("Day 1 - A to B")


def test_settings(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text("[roads]\nmatch_tolerance_mi = 0.05\n[compass]\nhold_secs = 4\n[info]\nformat = {speed:.0f} %%\n")
    got = config.load(str(path))
    assert (got.roads_match_tolerance_mi, got.compass_hold_secs, got.local_roads_match_grace_secs) == (0.05, 4, 2)
    assert got.info_format == "{speed:.0f} %%"
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"))
