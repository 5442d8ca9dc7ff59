"""Tables from files: tracks, labels, gaps, cities, roads, borders."""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace import schemas


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """A track's rows with ``ts``, boolean ``valid`` and ``row_seq`` (file order). The trip is the folder ``trip_id=``, where there are such, or the file."""
    rows = spark.read.schema(schemas.TRACK_CSV).csv(path, header=True).fillna("", ["town", "state"])
    trip = F.col("trip_id").cast("long") if "trip_id" in rows.columns else F.xxhash64(F.input_file_name())
    return rows.withColumns({"ts": F.to_timestamp_ntz("timestamp_utc", F.lit("yyyy-MM-dd HH:mm:ss")), "valid": F.col("valid") == 1, "row_seq": F.monotonically_increasing_id(), "trip_id": trip})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS_CSV).csv(path, header=True).fillna("", ["label"])


def _all_or_nothing(spark: SparkSession, path: str, schema: str, quiet_if_missing: bool) -> DataFrame:
    """A small file; a missing or malformed one is empty as a whole."""
    empty = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(path, header=True)
        rows.foreach(lambda _: None)
        return rows
    except AnalysisException:
        if not quiet_if_missing:
            print(f"warning: {path} is missing", file=sys.stderr)
    except PySparkException as malformed:
        print(f"warning: {path} can't be read: {malformed.getCondition()}", file=sys.stderr)
    except Exception as malformed:
        print(f"warning: {path} can't be read: {type(malformed).__name__}", file=sys.stderr)
    return empty


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    return _all_or_nothing(spark, path, schemas.GAPS_CSV, True)


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return _all_or_nothing(spark, path, schemas.CITIES_CSV, False).orderBy("rank")


def _features(spark: SparkSession, path: str) -> DataFrame:
    """(feature, route_id, route_type, kind, lines): the lines of the line features of a GeoJSON file, as arrays of numbers."""
    rows = spark.read.schema(schemas.GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    return rows.select("feature", F.col("f.properties.route_id").alias("route_id"), F.col("f.properties.route_type").alias("route_type"), lines.alias("lines")).where("lines IS NOT NULL")


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, points) with points (lon, lat); empty where the file is missing."""
    try:
        rows = _features(spark, path).select("feature", F.posexplode("lines").alias("part", "line"))
    except AnalysisException:
        print(f"warning: {path} is missing", file=sys.stderr)
        return spark.createDataFrame([], "feature int, part int, points array<struct<lon:double,lat:double>>")
    return rows.select("feature", "part", F.transform("line", lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))).alias("points"))


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """(road_seq, route_id, route_type, geometry): a road for each line with two points or more and an id; a coordinate must be
    [lon, lat]."""
    rows = _features(spark, path).where("coalesce(route_id, '') <> ''").select("feature", "route_id", F.coalesce("route_type", F.lit("interstate")).alias("route_type"), F.posexplode("lines").alias("part", "line"))
    pair = lambda c: F.when(F.size(c) == 2, F.struct(c[1].alias("lat"), c[0].alias("lon"))).otherwise(F.raise_error(F.lit("a coordinate isn't [lon, lat]")).cast("struct<lat:double,lon:double>"))
    return rows.where(F.size("line") >= 2).select((F.col("feature").cast("long") * (1 << 20) + F.col("part")).alias("road_seq"), "route_id", "route_type", F.transform("line", pair).alias("geometry"))
