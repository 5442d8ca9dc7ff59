"""Queries that write a table in its file format, read it back and return what was read, each beside its DuckDB text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waytrace.operators import memo, track as ops
from waytrace.plans import telemetry, views
from waytrace.plans.telemetry import query
from waytrace.plans.views import DARK_SQL, ROAD_SQL, TRACK_SQL
from waytrace.sources import files, sinks


def _path(spark: SparkSession, name: str) -> str:
    return f"{memo.shared_folder(spark)}/waytrace-{name}-{uuid.uuid4().hex}"


_CLIPS = """
clip AS (SELECT trip_id, concat('clip', lpad(CAST(sec // 20 AS VARCHAR), 4, '0')) AS clip, 20e0 + (sec // 20) * 5e-1 AS duration_sec FROM track GROUP BY ALL)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.track(spark, sf_dir).select("trip_id", "clip", F.expr("20e0 + floor(sec / 20) * 5e-1").alias("duration_sec")).distinct()


@query(
    "WITH "
    + TRACK_SQL
    + """
SELECT trip_id, sec AS row_no, concat('clip', lpad(CAST(sec // 20 AS VARCHAR), 4, '0')) AS clip, CAST(sec % 20 AS INT) AS sec_in_clip, round(sec + (event_id % 1000) * 1e-3, 3) AS global_sec,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, valid, lat, lon, speed_mph, heading, label AS town, state FROM track"""
)
def track_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip's track as a CSV file, in the order of its fixes."""
    rows = views.track(spark, sf_dir).withColumns(
        {
            "sec_in_clip": (F.col("sec") % 20).cast("int"),
            "global_sec": F.expr("sec + (event_id % 1000) * 1e-3"),
            "timestamp_utc": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            "town": F.col("label"),
        }
    )
    path = _path(spark, "tracks")
    sinks.write_tracks(rows, path)
    row_no = F.row_number().over(Window.partitionBy("trip_id").orderBy("row_seq")) - 1
    return files.read_track(spark, path).withColumn("row_no", row_no).drop("row_seq", "ts")


@query("WITH RECURSIVE " + TRACK_SQL + "," + telemetry._RUNS.format(source="labelled") + " SELECT trip_id, start_sec, end_sec, label FROM spans")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "labels")
    sinks.write_trip_spans(telemetry._spans(views.track(spark, sf_dir)), path)
    return files.read_labels(spark, path).withColumn("trip_id", F.col("trip_id").cast("long"))


@query("WITH " + TRACK_SQL + "," + DARK_SQL + " SELECT trip_id, start_sec, end_sec, concat('dark', CAST(trip_id AS VARCHAR)) AS clip FROM dark")
def gap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "gaps")
    dark = views.dark(views.totals(views.track(spark, sf_dir)))
    sinks.write_trip_spans(dark.withColumn("clip", F.concat(F.lit("dark"), F.col("trip_id").cast("string"))), path, "clip")
    return files.read_gaps(spark, path).withColumn("trip_id", F.col("trip_id").cast("long"))


@query("WITH " + telemetry._CITY + " SELECT rank, name, state, lat, lon FROM city")
def city_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "cities")
    telemetry._cities(spark, sf_dir).write.csv(path, header=True)
    return files.read_cities(spark, path)


def _road_file(spark: SparkSession, sf_dir: str) -> str:
    path = _path(spark, "roads")
    sinks.write_geojson(views.roads(spark, sf_dir), path)
    return path


def _pairs(line: str) -> Column:
    """Consecutive points of a line."""

    def pair(a: Column, b: Column) -> Column:
        return F.struct(F.round(a["lat"], 9).alias("lat"), F.round(a["lon"], 9).alias("lon"), F.round(b["lat"], 9).alias("next_lat"), F.round(b["lon"], 9).alias("next_lon"))

    points = F.col(line)
    return F.filter(F.zip_with(points, F.slice(points, 2, F.size(points)), pair), lambda s: s["next_lat"].isNotNull())


_SEGMENT = "round(alat, 9) AS lat, round(alon, 9) AS lon, round(blat, 9) AS next_lat, round(blon, 9) AS next_lon"


@query(
    "WITH "
    + ROAD_SQL
    + f"""
SELECT dense_rank() OVER (ORDER BY seq) - 1 AS road_no, route_id, CASE tier WHEN 0 THEN 'interstate' WHEN 1 THEN 'us_route' ELSE 'local' END AS route_type, {_SEGMENT} FROM road"""
)
def road_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All roads as one GeoJSON file, by their numbers; returned by segments."""
    held = files.read_roads(spark, _road_file(spark, sf_dir))
    return held.select(F.shiftright("road_seq", 20).alias("road_no"), "route_id", "route_type", F.explode(_pairs("geometry")).alias("s")).select("road_no", "route_id", "route_type", "s.*")


@query("WITH " + ROAD_SQL + f" SELECT CAST(dense_rank() OVER (ORDER BY seq) - 1 AS INT) AS feature, CAST(0 AS INT) AS part, {_SEGMENT} FROM road")
def border_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read as border lines."""
    held = files.read_borders(spark, _road_file(spark, sf_dir))
    return held.select("feature", "part", F.explode(_pairs("points")).alias("s")).select("feature", "part", "s.*")


@query("WITH " + TRACK_SQL + "," + _CLIPS + " SELECT trip_id, round(sum(duration_sec), 3) AS duration_sec FROM clip GROUP BY trip_id")
def trip_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.total_duration(_clips(spark, sf_dir))


@query("WITH " + TRACK_SQL + "," + _CLIPS + " SELECT 'file ''' || trip_id || '''\\'''' ' || clip || '''' AS value FROM clip")
def clip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name the clips, here with a quote in each name."""
    return sinks.clip_list(_clips(spark, sf_dir).withColumn("clip", F.concat(F.col("trip_id").cast("string"), F.lit("' "), F.col("clip"))))
