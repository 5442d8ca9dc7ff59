"""The telemetry that the queries run on, derived from ``events`` and ``nation``; and the same as DuckDB text.

A user is a trip, an event a fix, its number in the trip the video second; ``error`` events are void fixes. Roads are parallels, by nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAT = "34e0 + (trip_id % 25)*1e-1 + ((event_id*7919) % 1000 - 500)*1e-6 + CASE WHEN (sec % 35) >= 28 THEN 1e-2 ELSE 0e0 END"
LON = "-100e0 + sec*1e-2"
HEADING = "CAST((sec*5 + (event_id % 7)*3) % 360 AS DOUBLE)"
STATE = "CASE trip_id % 5 WHEN 0 THEN 'TN' WHEN 1 THEN 'TX' WHEN 2 THEN 'AZ' WHEN 3 THEN 'CA' ELSE 'WI' END"
LABEL = "CASE WHEN (sec % 20) >= 16 THEN '' ELSE concat('T', CAST((sec - sec % 8) % 3 AS VARCHAR(9))) END"
TOWN = "concat('T', CAST(event_id % 4 AS VARCHAR(9)))"
CC = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'MX' ELSE 'US' END"
ADMIN = "CASE event_id % 3 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Vermont' ELSE 'Elsewhere' END"

TRACK_SQL = f"""
trk0 AS (
  SELECT user_id AS trip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS sec,
         event_id, ts, value AS speed_mph, event_type <> 'error' AS valid FROM events),
track AS (
  SELECT *, {LAT} AS lat, {LON} AS lon, {HEADING} AS heading, {STATE} AS state, {LABEL} AS label FROM trk0),
totals AS (SELECT trip_id, max(sec) + 3 AS total_secs FROM track GROUP BY trip_id)"""

def road_sql(name: str, lines: str) -> str:
    """Segments of straight lines in fourteen points, and the file's miles per degree of longitude."""
    return f"""
{name} AS (
  SELECT seq, route_id, tier, rlat + slope * (i * 2e-1 - 8e-1) AS alat, -100.6e0 + i * 2e-1 AS alon, rlat + slope * ((i + 1) * 2e-1 - 8e-1) AS blat, -100.6e0 + (i + 1) * 2e-1 AS blon
  FROM ({lines}), (SELECT unnest(range(13)) AS i)),
{name}_scale AS (SELECT 69.172e0 * greatest(cos(radians(avg(alat))), 0.2e0) AS kx FROM {name})"""


#: Parallels, twins beside some of them, slanted roads, and roads of a lower type with the name of a slanted one.
ROAD_SQL = road_sql("road", """
  SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 2 = 0 THEN concat('I-', CAST(n_nationkey AS VARCHAR(9))) ELSE concat('US ', CAST(n_nationkey AS VARCHAR(9))) END AS route_id,
         CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END AS tier, 34e0 + n_nationkey*1e-1 AS rlat, 0e0 AS slope FROM nation
  UNION ALL
  SELECT 100 + n_nationkey, concat('US 9', CAST(n_nationkey AS VARCHAR(9))), 1, 34e0 + n_nationkey*1e-1 + 1e-4, 0e0 FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL
  SELECT 200 + n_nationkey, concat('US 8', CAST(n_nationkey AS VARCHAR(9))), 1, 34e0 + n_nationkey*1e-1, 3e-3 FROM nation WHERE n_nationkey % 3 = 1
  UNION ALL
  SELECT 300 + n_nationkey, concat('US 8', CAST(n_nationkey AS VARCHAR(9))), 99, 34e0 + n_nationkey*1e-1 + 5e-5, -1e-4 FROM nation WHERE n_nationkey % 3 = 1""")

LOCAL_SQL = road_sql("local_road", """
  SELECT n_nationkey AS seq, concat('Lane ', CAST(n_nationkey AS VARCHAR(9))) AS route_id, 99 AS tier, 34e0 + n_nationkey*1e-1 + CASE WHEN n_nationkey % 3 = 0 THEN 1e-2 ELSE -3e-4 END AS rlat, CASE WHEN n_nationkey % 3 = 2 THEN -2e-3 ELSE 0e0 END AS slope FROM nation""")

DARK_SQL = """
dark AS (
  SELECT trip_id, 5.5e0 + trip_id % 7 AS start_sec, 9.2e0 + trip_id % 7 AS end_sec FROM totals
  UNION ALL SELECT trip_id, 8e0 + trip_id % 7, 11e0 + trip_id % 7 FROM totals
  UNION ALL SELECT trip_id, 25e0 + trip_id % 7, 27e0 + trip_id % 7 FROM totals)"""

RATIO = 69.172


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 3958.76e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fixes = events.select(
        F.col("user_id").alias("trip_id"),
        (F.row_number().over(by_time) - 1).cast("int").alias("sec"),
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("speed_mph"),
        (F.col("event_type") != "error").alias("valid"),
    )
    exprs = {"lat": LAT, "lon": LON, "heading": HEADING, "state": STATE, "label": LABEL}
    rows = fixes.withColumns({name: F.expr(e) for name, e in exprs.items()})
    clip = F.concat(F.lit("clip"), F.lpad(F.floor(F.col("sec") / 20).cast("string"), 4, "0"))
    return rows.withColumns({"global_sec": F.col("sec").cast("double"), "row_seq": F.col("sec").cast("long"), "clip": clip})


def totals(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("trip_id").agg((F.max("sec") + 3).cast("int").alias("total_secs"))


def _lines(rows: DataFrame) -> DataFrame:
    """Straight lines in fourteen points from 100.6 to 98 degrees west."""
    line = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.struct((F.col("rlat") + F.col("slope") * (i * 0.2 - 0.8)).alias("lat"), (F.lit(-100.6) + i * 0.2).alias("lon")))
    return rows.withColumn("geometry", line).drop("rlat", "slope")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = F.col("n_nationkey")
    name = F.when(n % 2 == 0, F.concat(F.lit("I-"), n.cast("string"))).otherwise(F.concat(F.lit("US "), n.cast("string")))
    kind = F.when(n % 2 == 0, "interstate").otherwise("us_route")
    def some(shift: int, name, kind, lat: str, slope: float, where: str = "true") -> DataFrame:
        return nation.where(where).select((n + shift).cast("long").alias("road_seq"), name.alias("route_id"), kind.alias("route_type"), F.expr(lat).alias("rlat"), F.lit(slope).alias("slope"))

    named = lambda prefix: F.concat(F.lit(prefix), n.cast("string"))
    main = some(0, name, kind, "34e0 + n_nationkey*1e-1", 0.0)
    twin = some(100, named("US 9"), F.lit("us_route"), "34e0 + n_nationkey*1e-1 + 1e-4", 0.0, "n_nationkey % 5 = 0")
    slanted = some(200, named("US 8"), F.lit("us_route"), "34e0 + n_nationkey*1e-1", 3e-3, "n_nationkey % 3 = 1")
    lower = some(300, named("US 8"), F.lit("local"), "34e0 + n_nationkey*1e-1 + 5e-5", -1e-4, "n_nationkey % 3 = 1")
    return _lines(main.unionByName(twin).unionByName(slanted).unionByName(lower))


def local_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = F.col("n_nationkey")
    lat = F.expr("34e0 + n_nationkey*1e-1 + CASE WHEN n_nationkey % 3 = 0 THEN 1e-2 ELSE -3e-4 END")
    return _lines(nation.select(n.cast("long").alias("road_seq"), F.concat(F.lit("Lane "), n.cast("string")).alias("route_id"), F.lit("local").alias("route_type"), lat.alias("rlat"), F.when(n % 3 == 2, -2e-3).otherwise(0.0).alias("slope")))


def dark(whole: DataFrame) -> DataFrame:
    shift = F.col("trip_id") % 7
    spans = F.array(*[F.struct((F.lit(a) + shift).alias("start_sec"), (F.lit(b) + shift).alias("end_sec")) for a, b in ((5.5, 9.2), (8.0, 11.0), (25.0, 27.0))])
    return whole.select("trip_id", F.explode(spans).alias("s")).select("trip_id", "s.*")


def seconds(fixes: DataFrame) -> DataFrame:
    """One row a second, as the fixes are."""
    return fixes.select("trip_id", "sec", "lat", "lon", "heading", "speed_mph")


def uneven(fixes: DataFrame) -> DataFrame:
    """The same fixes on an uneven clock: several in some seconds, parts of seconds, and gaps."""
    return fixes.withColumn("global_sec", F.expr("sec * 6e-1 + (event_id % 3) * 1e-1 + CASE WHEN sec >= 30 THEN 7e0 ELSE 0e0 END"))


UNEVEN_SQL = """
uneven AS (SELECT *, sec * 6e-1 + (event_id % 3) * 1e-1 + CASE WHEN sec >= 30 THEN 7e0 ELSE 0e0 END AS global_sec FROM track),
uneven_totals AS (SELECT trip_id, CAST(ceil(max(global_sec)) AS INT) + 1 AS total_secs FROM uneven GROUP BY trip_id)"""
