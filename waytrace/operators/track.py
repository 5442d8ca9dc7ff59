"""Operators over the fixes of trips: odometer, speeds, gaps, clip clock, towns, info line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waytrace.functions import formats, scalar
from waytrace.operators import spatial
from waytrace.functions.dimensions import ABBREVIATION_OF

INFO_FORMAT = "{speed:.0f} mph   {dist:.0f} mi   {remain:.0f} mi to go   {time}"


def _by_time() -> Window:
    return Window.partitionBy("trip_id").orderBy("global_sec", "row_seq")


def valid_fixes(track: DataFrame) -> DataFrame:
    return track.where("valid")


def odometer(track: DataFrame) -> DataFrame:
    """Adds hop (miles from the previous valid fix; void fixes have none), miles so far and remaining.

    A void fix carries the running value and doesn't break the chain."""
    w = _by_time()
    point = F.when(F.col("valid"), F.struct("lat", "lon"))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hop = F.when(F.col("valid") & F.col("_before").isNotNull(), scalar.haversine_miles(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon")))
    hops = track.withColumn("_before", before).withColumn("hop", hop).drop("_before")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = hops.withColumn("miles", F.coalesce(F.sum("hop").over(upto), F.lit(0.0)))
    return summed.withColumn("remaining", F.greatest(F.last("miles").over(whole) - F.col("miles"), F.lit(0.0)))


def average_speeds(track: DataFrame, name: str = "average_mph") -> DataFrame:
    """Adds the speed over the ground since the previous row; the device's where either row is void, for
    the first row, and where no time went by. A void row breaks the chain."""
    w = _by_time()
    hours = scalar.minutes_between(F.lag("ts").over(w), F.col("ts")) / 60
    miles = scalar.haversine_miles(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    chained = F.col("valid") & F.coalesce(F.lag("valid").over(w), F.lit(False))
    staged = track.withColumns({"_hours": hours, "_miles": miles, "_chained": chained})
    speed = F.when(F.col("_chained") & (F.col("_hours") > 0), F.col("_miles") / F.col("_hours")).otherwise(F.col("speed_mph"))
    return staged.withColumn(name, speed).drop("_hours", "_miles", "_chained")


def time_gaps(track: DataFrame, threshold_minutes: float = 10.0, digits: int = 1) -> DataFrame:
    """Pairs of valid fixes in a row, by clock, that are ``threshold_minutes`` apart or more."""
    w = Window.partitionBy("trip_id").orderBy("ts", "row_seq")
    before = F.lag(F.struct("clip", "ts", "lat", "lon", "row_seq")).over(w)
    pairs = valid_fixes(track).withColumn("_b", before).withColumn("_gap", scalar.minutes_between(F.col("_b.ts"), F.col("ts"))).where(F.col("_gap") >= threshold_minutes)
    return pairs.select(
        "trip_id",
        F.col("_b.clip").alias("before_clip"),
        F.col("_b.ts").alias("before_ts"),
        F.col("_b.row_seq").alias("before_seq"),
        F.col("clip").alias("after_clip"),
        F.col("ts").alias("after_ts"),
        F.col("row_seq").alias("after_seq"),
        F.round("_gap", digits).alias("gap_minutes"),
        F.round(scalar.haversine_miles(F.col("_b.lat"), F.col("_b.lon"), F.col("lat"), F.col("lon")), digits).alias("straight_line_mi"),
    )


def clip_offsets(clips: DataFrame) -> DataFrame:
    """Adds each clip's start on the video clock: the durations of all clips before it (by path), dark ones too."""
    before = Window.partitionBy("trip_id").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("offset_sec", F.coalesce(F.sum("duration_sec").over(before), F.lit(0.0)))


def on_video_clock(fixes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Fixes of known clips with global_sec, to 3 places; fixes of dropped clips go."""
    return fixes.join(offsets.select("trip_id", "clip", "offset_sec"), ["trip_id", "clip"]).withColumn("global_sec", F.round(F.col("offset_sec") + F.col("sec_in_clip"), 3)).drop("offset_sec")


def dark_spans(offsets: DataFrame, fixes: DataFrame) -> DataFrame:
    """(trip_id, start_sec, end_sec, clip) of the clips without any fix."""
    lit = fixes.select("trip_id", "clip").distinct()
    return offsets.join(lit, ["trip_id", "clip"], "left_anti").select("trip_id", F.col("offset_sec").alias("start_sec"), (F.col("offset_sec") + F.col("duration_sec")).alias("end_sec"), "clip")


def total_duration(clips: DataFrame) -> DataFrame:
    return clips.groupBy("trip_id").agg(F.round(F.sum("duration_sec"), 3).alias("duration_sec"))


def coordinate_keys(track: DataFrame) -> DataFrame:
    """The distinct valid coordinates, to 3 places."""
    return valid_fixes(track).select(F.round("lat", 3).alias("lat3"), F.round("lon", 3).alias("lon3")).distinct()


def with_places(track: DataFrame, places: DataFrame) -> DataFrame:
    """Adds ``place`` (name, admin1, cc) by rounded coordinates; NULL for void fixes and unknown places."""
    keyed = places.select(F.round("lat", 3).alias("lat3"), F.round("lon", 3).alias("lon3"), F.struct("name", "admin1", "cc").alias("place")).dropDuplicates(["lat3", "lon3"])
    void = F.when(F.col("valid"), F.round("lat", 3))
    return track.withColumn("lat3", void).withColumn("lon3", F.round("lon", 3)).join(keyed, ["lat3", "lon3"], "left").drop("lat3", "lon3")


def geocoded(track: DataFrame, places: DataFrame) -> DataFrame:
    """Adds ``place``: the one of ``places`` (lat, lon, name, admin1, cc) nearest to the rounded coordinate, each of which is looked up once."""
    keys = coordinate_keys(track).select(F.col("lat3").alias("lat"), F.col("lon3").alias("lon"))
    found = spatial.nearest_places(keys, places).where("place IS NOT NULL")
    return with_places(track, found.select("lat", "lon", "place.*"))


def resolved_towns(track: DataFrame) -> DataFrame:
    """Adds town and state from ``place``: in the US its own; abroad the last US one, if any; without a place blank."""
    upto = _by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.coalesce(F.try_element_at(scalar.literal_map(ABBREVIATION_OF), F.col("place.admin1")), F.col("place.admin1"))
    home = F.when(F.col("place.cc") == "US", F.struct(F.col("place.name").alias("town"), state.alias("state")))
    kept = F.when(F.col("place").isNotNull(), F.last(home, ignorenulls=True).over(upto))
    found = track.withColumn("_kept", kept)
    return found.withColumn("town", F.coalesce("_kept.town", F.lit(""))).withColumn("state", F.coalesce("_kept.state", F.lit(""))).drop("_kept")


def town_labels(track: DataFrame, template: str = "{name}, {state}") -> DataFrame:
    label = F.when(F.col("town") == "", "").otherwise(formats.joined(template, {"name": F.col("town"), "state": F.col("state")}))
    return track.withColumn("label", label)


def info_segments(track: DataFrame, template: str = INFO_FORMAT, speed_source: str = "average", adjust_hours: float = 0.0) -> DataFrame:
    """Adds ``segments`` (text, is_dim) of the info line to every fix, void ones too."""
    rows = odometer(average_speeds(track))
    zone = F.when(F.coalesce(F.col("state"), F.lit("")) != "", scalar.zone_of(F.col("state"), F.col("lon")))
    numbers: dict[str, Column] = {"speed": F.col("average_mph" if speed_source == "average" else "speed_mph"), "dist": F.col("miles"), "remain": F.col("remaining")}
    texts = {"time": scalar.local_time(F.col("ts"), zone, adjust_hours), "date": scalar.local_date(F.col("ts"), zone, adjust_hours)}
    return rows.withColumn("segments", formats.segments(template, numbers, texts)).drop("hop", "miles", "remaining", "average_mph")


def info_spans(points: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(trip_id, start_sec, end_sec, label) of each point's info text: up to the next point; the last to the end of the video."""
    w = _by_time()
    rows = points if ends is None else points.join(ends.select("trip_id", F.col("duration_sec").alias("_end")), "trip_id", "left")
    last = F.col("global_sec") + 1.0
    last = last if ends is None else F.greatest(last, F.col("_end"))
    return rows.select("trip_id", F.col("global_sec").alias("start_sec"), F.coalesce(F.lead("global_sec").over(w), last).alias("end_sec"), formats.ass_text(F.col("segments")).alias("label"), "row_seq")


def trip_summary(track: DataFrame, gap_minutes: float = 10.0) -> DataFrame:
    """Per trip: fixes, valid ones, miles, the longest hop, gaps."""
    by_clock = Window.partitionBy("trip_id").orderBy("ts", "row_seq")
    clock = F.last(F.when(F.col("valid"), F.col("ts")), ignorenulls=True).over(by_clock.rowsBetween(Window.unboundedPreceding, -1))
    rows = odometer(track).withColumn("_gap", F.col("valid") & (scalar.minutes_between(clock, F.col("ts")) >= gap_minutes))
    return rows.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n_fixes"),
        F.count_if("valid").alias("n_valid"),
        F.round(F.coalesce(F.sum("hop"), F.lit(0.0)), 4).alias("miles"),
        F.round(F.coalesce(F.max("hop"), F.lit(0.0)), 4).alias("max_hop"),
        F.count_if("_gap").alias("n_gaps"),
    )


def systematic_sample(track: DataFrame, every: int = 20) -> DataFrame:
    """Every nth valid fix of a trip, from the first."""
    n = F.row_number().over(Window.partitionBy("trip_id").orderBy("row_seq")) - 1
    return valid_fixes(track).withColumn("_n", n).where(F.col("_n") % every == 0).drop("_n")


def downsampled_route(seconds: DataFrame, target: int = 600) -> DataFrame:
    """Every (n div target)th second of a trip's route, and its last point once more at the end (ord counts them)."""
    w = Window.partitionBy("trip_id").orderBy("sec")
    rows = seconds.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trip_id")))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    kept = rows.where(F.col("_i") % step == 0).withColumn("ord", F.floor(F.col("_i") / step))
    last = rows.where(F.col("_i") == F.col("_n") - 1).withColumn("ord", F.floor(F.col("_i") / step) + 1)
    return kept.unionByName(last).drop("_i", "_n")
