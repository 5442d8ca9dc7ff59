"""Scalar functions and formats on known vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waytrace.functions import formats, scalar


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lits(*values):
    return [F.lit(v) for v in values]


def test_nmea(spark):
    a, b = one(spark, scalar.nmea_to_decimal(*lits(3612.8003, "N")), scalar.nmea_to_decimal(*lits(8315.501, "W")))
    assert (round(a, 5), round(b, 5)) == (36.21334, -83.25835)


def test_haversine(spark):
    (a,) = one(spark, scalar.haversine_miles(*lits(36.0, -83.0, 37.0, -83.0)))
    assert abs(a - 69.09) < 0.01


@pytest.mark.parametrize(("state", "lon", "zone"), [("TN", -83.9, "America/New_York"), ("TN", -86.8, "America/Chicago"), ("TN", -85.3, "America/Chicago"), ("TX", -106.4, "America/Denver"), ("TX", -96.8, "America/Chicago"), ("AZ", -110.0, "America/Phoenix"), ("WI", -90.0, None), ("FL", -86.0, "America/Chicago")])
def test_zone(spark, state, lon, zone):
    assert one(spark, scalar.zone_of(*lits(state, lon)))[0] == zone


@pytest.mark.parametrize(("ts", "zone", "time", "date"), [("2022-05-23 14:31:00", "America/Chicago", "09:31 CDT", "2022-05-23"), ("2022-05-27 19:05:00", "America/Phoenix", "12:05 MST", "2022-05-27"), ("2022-05-24 03:00:00", "America/Chicago", "22:00 CDT", "2022-05-23"), ("2022-01-05 03:00:00", "America/Los_Angeles", "19:00 PST", "2022-01-04"), ("2022-05-24 03:00:00", None, "03:00 UTC", "2022-05-24")])
def test_local_time(spark, ts, zone, time, date):
    clock = F.lit(ts).cast("timestamp_ntz")
    zone = F.lit(zone).cast("string")
    assert tuple(one(spark, scalar.local_time(clock, zone), scalar.local_date(clock, zone))) == (time, date)


def test_adjusted_clock(spark):
    clock = F.lit("2022-05-24 03:00:00").cast("timestamp_ntz")
    assert one(spark, scalar.localized(clock, F.lit("UTC"), -1.5))[0] == dt.datetime(2022, 5, 24, 1, 30)


@pytest.mark.parametrize(("sec", "text"), [(0.0, "0:00:00.00"), (3661.5, "1:01:01.50"), (59.999, "0:01:00.00")])
def test_ass_time(spark, sec, text):
    assert one(spark, scalar.ass_time(F.lit(sec)))[0] == text


def test_ass_time_negative(spark):
    with pytest.raises(Exception, match="negative"):
        one(spark, scalar.ass_time(F.lit(-1.0)))


@pytest.mark.parametrize(("text", "halves"), [("072", ("0", "72")), ("0000", ("000", "0")), ("999", ("", "999")), ("0", ("", "0")), ("-007", ("-00", "7"))])
def test_leading_zeros(spark, text, halves):
    assert tuple(one(spark, scalar.leading_zeros(F.lit(text)))[0]) == halves


@pytest.mark.parametrize(("name", "kind", "wanted"), [("I- 395 Hov", "I", "I-395"), ("US Hwy 70", "U", "US 70"), ("Ramp", "I", None), (None, "I", None)])
def test_highway_id(spark, name, kind, wanted):
    assert one(spark, scalar.highway_id(F.lit(name).cast("string"), F.lit(kind)))[0] == wanted


@pytest.mark.parametrize(("h", "four", "eight"), [(0.0, "N", "N"), (44.9, "N", "NE"), (45.0, "E", "NE"), (359.9, "N", "N"), (-10.0, "N", "N"), (200.0, "S", "S"), (315.0, "N", "NW"), (270.0, "W", "W")])
def test_headings(spark, h, four, eight):
    assert tuple(one(spark, scalar.cardinal4(F.lit(h)), scalar.compass8(F.lit(h)))) == (four, eight)


def test_compass_label_keeps_360(spark):
    assert one(spark, scalar.compass_label(F.lit(359.6)))[0] == "N 360°"


def test_circular_mean(spark):
    rows = spark.createDataFrame([(350.0,), (10.0,)], "h double")
    mean = rows.agg(scalar.circular_mean(F.sum(F.sin(F.radians("h"))), F.sum(F.cos(F.radians("h")))).alias("m")).first().m
    assert min(mean, 360 - mean) < 1e-9


def test_letterbox(spark):
    pad = one(spark, scalar.letterbox_pad(100, 100, F.lit(2.0), F.lit(1.0), F.lit(0.0)))[0]
    assert (pad.lon_pad, round(pad.lat_pad, 9)) == (0.0, 0.5)


def test_canvas_height_is_clamped(spark):
    tall, flat = one(spark, scalar.canvas_height(300, F.lit(50.0), F.lit(1.0), F.lit(0.0)), scalar.canvas_height(300, F.lit(0.01), F.lit(10.0), F.lit(0.0)))
    assert (tall, flat) == (600, 100)


def test_colours_and_paths(spark):
    assert one(spark, scalar.ass_colour(F.lit("#a1b2c3")), scalar.filter_path(F.lit("C:\\x\\y.ass"))) == ("&H00C3B2A1", "C\\:/x/y.ass")


def test_polyline(spark):
    point = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    line, dot = F.array(point(35.0, -100.0), point(35.0, -99.0)), F.array(point(35.0, -100.0))
    a, b = one(spark, scalar.polyline_miles(F.lit(35.01), F.lit(-99.5), line), scalar.polyline_miles(F.lit(36.0), F.lit(-100.0), dot))
    assert abs(a - 0.69172) < 1e-9
    assert abs(b - 69.172) < 1e-9


def test_labels(spark):
    extras = F.array(F.lit("US 70"))
    none = F.lit(None).cast("string")
    got = one(spark, scalar.route_label(*lits("I-40", "W"), extras), scalar.route_label(F.lit("I-40"), none, extras), scalar.shield_number(F.lit("US 70")), scalar.day_title(*lits(2, "A", "B")))
    assert tuple(got) == ("I-40 / US 70 WB", None, "70", "Day 2 - A to B")


def test_overlay_corner():
    assert scalar.overlay_xy("bottom_left", 4) == "4:main_h-overlay_h-4"
    assert scalar.overlay_xy("nowhere", 4) == scalar.overlay_xy("top_right", 4)


def test_format_segments(spark):
    pieces = formats.segments("{speed:03.0f} mph {time}", {"speed": F.lit(7.2)}, {"time": F.lit("09:31 CDT")})
    assert [tuple(p) for p in one(spark, pieces)[0]] == [("00", True), ("7", False), (" mph ", False), ("09:31 CDT", False)]
    assert one(spark, formats.ass_text(pieces))[0] == "{\\c&H808080&}00{\\c&HFFFFFF&}7 mph 09:31 CDT"


@pytest.mark.parametrize("bad", ["{what}", "{speed:zz}"])
def test_bad_format_raises(bad, spark):
    with pytest.raises(ValueError):
        formats.segments(bad, {"speed": F.lit(1.0)}, {})


@pytest.mark.parametrize(("value", "spec", "text"), [(0.5, ".0f", "0"), (2.5, ".0f", "2"), (-7.0, "04.0f", "-007"), (3.14159, ".2f", "3.14"), (5.0, "4.0f", "   5")])
def test_number_formats(spark, value, spec, text):
    assert one(spark, formats.formatted(F.lit(value), spec, True))[0] == text
