"""Preparing road data: states a track touches, shapes to roads, roads in a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waytrace.functions import scalar
from waytrace.functions.dimensions import STATE_ROWS


def state_codes(spark) -> DataFrame:
    return spark.createDataFrame([(short, code) for _, short, code in STATE_ROWS], "state string, census_code string")


def state_boxes(track: DataFrame, pad_deg: float = 0.15) -> DataFrame:
    """(state, census_code, min_lat, max_lat, min_lon, max_lon) of the valid fixes in each known state, padded."""
    rows = track.where("valid AND state <> ''")
    box = rows.groupBy("state").agg(*[f.alias(n) for n, f in (("min_lat", F.min("lat") - pad_deg), ("max_lat", F.max("lat") + pad_deg), ("min_lon", F.min("lon") - pad_deg), ("max_lon", F.max("lon") + pad_deg))])
    return box.join(F.broadcast(state_codes(track.sparkSession)), "state")


def unknown_states(track: DataFrame) -> DataFrame:
    """The states of valid fixes that have no code, sorted."""
    rows = track.where("valid AND state <> ''").select("state").distinct()
    return rows.join(F.broadcast(state_codes(track.sparkSession)), "state", "left_anti").orderBy("state")


def shape_parts(points: Column, parts: Column) -> Column:
    """A shape's points cut at its parts' offsets."""
    return F.transform(parts, lambda start, i: F.slice(points, start + 1, F.coalesce(F.get(parts, i + 1), F.size(points)) - start))


def any_vertex_in(points: Column, box: Column) -> Column:
    return F.exists(points, lambda p: scalar.in_bbox(p["lat"], p["lon"], box))


def _lines(shapes: DataFrame, box: Column) -> DataFrame:
    cut = shapes.withColumn("geometry", F.explode(shape_parts(F.col("points"), F.col("parts"))))
    return cut.where(F.size("geometry") >= 2).where(any_vertex_in(F.col("geometry"), box))


def highway_roads(shapes: DataFrame, box: Column) -> DataFrame:
    """Interstates and US routes of shapes (RTTYP, MTFCC, FULLNAME, points, parts) with a vertex in the box."""
    named = shapes.where(F.col("RTTYP").isin("I", "U")).withColumn("route_id", scalar.highway_id(F.col("FULLNAME"), F.col("RTTYP"))).where("route_id IS NOT NULL")
    kind = F.when(F.col("RTTYP") == "I", "interstate").otherwise("us_route")
    return _lines(named, box).select("route_id", kind.alias("route_type"), "geometry")


def local_roads(shapes: DataFrame, box: Column) -> DataFrame:
    """Secondary and local streets with a name."""
    named = shapes.where(F.col("MTFCC").isin("S1200", "S1400")).withColumn("route_id", F.trim("FULLNAME")).where("route_id <> ''")
    return _lines(named, box).select("route_id", F.lit("local").alias("route_type"), "geometry")


def counties_of(points: DataFrame, counties: DataFrame) -> DataFrame:
    """The distinct counties (county_code and a box) that points fall into; boxes and points meet by whole-degree cells."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    cells = counties.withColumn("cy", spread("min_lat", "max_lat")).withColumn("cx", spread("min_lon", "max_lon"))
    placed = points.select("lat", "lon", F.floor("lat").alias("cy"), F.floor("lon").alias("cx"))
    return placed.join(cells, ["cx", "cy"]).where("lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon").select("county_code").distinct()
