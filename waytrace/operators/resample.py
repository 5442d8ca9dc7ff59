"""Fixes to whole video seconds: last fix of a second wins, gaps are filled forward, the start backward.

``track`` has trip_id, global_sec and row_seq (file order). Every window is partitioned by trip, so trips
spread over the cluster; a trip's rows are sorted, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_seconds(track: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """(trip_id, total_secs): the rounded-up duration, else the second behind the last fix."""
    last = track.groupBy("trip_id").agg((F.ceil(F.max("global_sec")) + 1).cast("int").alias("total_secs"))
    if durations is None:
        return last
    known = durations.select("trip_id", F.ceil("duration_sec").cast("int").alias("_known"))
    return last.join(known, "trip_id", "left").select("trip_id", F.coalesce("_known", "total_secs").alias("total_secs"))


def spine(totals: DataFrame) -> DataFrame:
    """A row for each second of each trip."""
    return totals.where("total_secs > 0").select("trip_id", F.explode(F.sequence(F.lit(0), F.col("total_secs") - 1)).alias("sec"))


def last_per_second(track: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(trip_id, sec, columns): of the fixes in one second the last by ``order``."""
    picked = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return track.groupBy("trip_id", F.col("global_sec").cast("int").alias("sec")).agg(picked).select("trip_id", "sec", "_last.*")


def fill_seconds(track: DataFrame, totals: DataFrame, columns: list[str], valid_only: bool = True, order: list[str] | None = None) -> DataFrame:
    """The spine with each second's last known values; before the first fix, that fix's values.

    ``columns`` are carried as a unit. The values that fill the start are those of the smallest second seen, in the
    spine or not. ``valid_only`` drops void fixes first. Trips without a fix to show are left out."""
    rows = track.where("valid") if valid_only else track
    seen = last_per_second(rows, columns, order or ["row_seq"]).select("trip_id", "sec", F.struct(*columns).alias("_unit"))
    first = seen.groupBy("trip_id").agg(F.min_by("_unit", "sec").alias("_first"))
    by_sec = Window.partitionBy("trip_id").orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = spine(totals).join(seen, ["trip_id", "sec"], "left").withColumn("_held", F.last("_unit", ignorenulls=True).over(by_sec))
    filled = laid.join(first, "trip_id").select("trip_id", "sec", F.coalesce("_held", "_first").alias("_unit"))
    return filled.select("trip_id", "sec", "_unit.*")


def positions_per_second(track: DataFrame, totals: DataFrame) -> DataFrame:
    return fill_seconds(track, totals, ["lat", "lon"])


def headings_per_second(track: DataFrame, totals: DataFrame) -> DataFrame:
    return fill_seconds(track, totals, ["heading"])


def speeds_per_second(track: DataFrame, totals: DataFrame) -> DataFrame:
    return fill_seconds(track, totals, ["speed_mph"])


def info_per_second(points: DataFrame, totals: DataFrame, column: str = "segments") -> DataFrame:
    """Void fixes count here, and of equal seconds the later by time, then by file order."""
    return fill_seconds(points, totals, [column], valid_only=False, order=["global_sec", "row_seq"])


def held(value: Column, accepted: Column, window) -> Column:
    """The last accepted value up to the current row."""
    return F.last(F.when(accepted, value), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
