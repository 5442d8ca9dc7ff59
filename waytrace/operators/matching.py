"""State machines along a trip: road hysteresis, compass smoothing and debouncing, label placement.

What is asked of the roads at a second doesn't depend on the state, so one range join answers it for all
seconds beforehand. Only the fold itself runs per trip, over small rows in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waytrace.functions import scalar
from waytrace.operators import spatial

OCTANTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def match_roads(seconds: DataFrame, roads: DataFrame, tolerance_mi: float = 0.031, grace: int = 3, freeze_mph: float = 3.0, max_extra: int = 0) -> DataFrame:
    """(trip_id, sec, route_id, cardinal, extras) of ``seconds`` (trip_id, sec, lat, lon, heading, speed_mph).

    A road is kept while the trip is within the tolerance of it, and for up to ``grace`` seconds outside; then, in the same
    second, the best road there is taken, if any. ``extras`` are up to ``max_extra`` other roads there, best first, where a road
    is matched. Below ``freeze_mph`` (but for the first second; NULL speed never) the last output stands and nothing moves on."""
    return follow_roads(seconds, spatial.candidates(seconds, roads, tolerance_mi, ["trip_id", "sec"]), grace, freeze_mph, max_extra)


def follow_roads(seconds: DataFrame, found: DataFrame, grace: int, freeze_mph: float, max_extra: int = 0) -> DataFrame:
    key = ["trip_id", "sec"]
    ranked = F.struct("tier", "acquire_mi", "road_seq", "route_id")
    asked = found.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("acquire_mi").isNotNull(), ranked))), lambda c: c["route_id"]).alias("near"),
        F.collect_list(F.when(F.col("hold_mi").isNotNull(), F.col("route_id"))).alias("hold"),
    )
    rows = seconds.select(*key, F.col("speed_mph"), scalar.cardinal4(F.col("heading")).alias("facing")).join(asked, key, "left")

    def fold(trip: pd.DataFrame) -> pd.DataFrame:
        trip = trip.sort_values("sec")
        current, off, last, out = None, 0, None, []
        for speed, facing, near, hold in zip(trip["speed_mph"], trip["facing"], trip["near"], trip["hold"], strict=True):
            if last is None or not speed < freeze_mph:
                near = [] if near is None else list(near)
                if current is not None and hold is not None and current in hold:
                    off = 0
                elif current is not None and off < grace:
                    off += 1
                else:
                    current, off = (near[0] if near else None), 0
                last = (None, None, []) if current is None else (current, facing, [r for r in near if r != current][:max_extra])
            out.append(last)
        return pd.DataFrame({"trip_id": trip["trip_id"], "sec": trip["sec"], **{name: [o[i] for o in out] for i, name in enumerate(("route_id", "cardinal", "extras"))}})

    return rows.groupBy("trip_id").applyInPandas(fold, "trip_id long, sec int, route_id string, cardinal string, extras array<string>")


def merged_matches(first: DataFrame, second: DataFrame) -> DataFrame:
    """(trip_id, sec, route_id, cardinal, highway_id, local_id, extras): the first match as a whole where it has a road, else the
    second; ``extras`` are the first's."""
    kept = ["extras"] if "extras" in first.columns else []
    a = first.select("trip_id", "sec", F.struct("route_id", "cardinal").alias("a"), *kept)
    b = second.select("trip_id", "sec", F.struct("route_id", "cardinal").alias("b"))
    picked = F.when(F.coalesce(F.col("a.route_id"), F.lit("")) != "", F.col("a")).otherwise(F.col("b"))
    return a.join(b, ["trip_id", "sec"], "full").select("trip_id", "sec", picked.alias("m"), F.col("a.route_id").alias("highway_id"), F.col("b.route_id").alias("local_id"), *kept).select("trip_id", "sec", "m.*", "highway_id", "local_id", *kept)


def concurrent_designations(seconds: DataFrame, matches: DataFrame, found: DataFrame, most: int = 1, freeze_mph: float = 3.0) -> DataFrame:
    """(trip_id, sec, extras): other routes along the matched one; frozen like the match; none where there is no match.

    The same as the extras of ``follow_roads``, for matches that were made before (a kept table)."""
    key = ["trip_id", "sec"]
    own = matches.select(*key, "route_id")
    extras = spatial.concurrent_roads(found, own.where("route_id IS NOT NULL"), key, most)
    rows = own.join(extras, key, "left").join(seconds.select(*key, "speed_mph"), key)
    w = Window.partitionBy("trip_id").orderBy("sec")
    none = F.array().cast("array<string>")
    frozen = (F.row_number().over(w) > 1) & F.coalesce(F.col("speed_mph") < freeze_mph, F.lit(False))
    rows = rows.withColumn("_now", F.when(F.col("route_id").isNotNull(), F.coalesce("extras", none)).otherwise(none)).withColumn("_frozen", frozen)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*key, F.last(F.when(~F.col("_frozen"), F.col("_now")), ignorenulls=True).over(upto).alias("extras"))


def compass(seconds: DataFrame, window: int = 5, freeze_mph: float = 3.0) -> DataFrame:
    """(trip_id, sec, smooth, shown): the circular mean of ``window`` // 2 seconds to either side, and the last one at speed
    (before the first, the trip's first)."""
    w, half = Window.partitionBy("trip_id").orderBy("sec"), window // 2
    around = w.rowsBetween(-half, half)
    mean = scalar.circular_mean(F.sum(F.sin(F.radians("heading"))).over(around), F.sum(F.cos(F.radians("heading"))).over(around))
    rows = seconds.withColumn("smooth", mean)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moving = F.coalesce(F.col("speed_mph") >= freeze_mph, F.lit(True))
    shown = F.coalesce(F.last(F.when(moving, F.col("smooth")), ignorenulls=True).over(upto), F.first("smooth").over(upto))
    return rows.select("trip_id", "sec", "smooth", shown.alias("shown"))


def debounced_octants(headings: DataFrame, column: str = "heading", hold: int = 2) -> DataFrame:
    """(trip_id, sec, octant): changes to the present octant once more than ``hold`` seconds in a row weren't the shown one."""
    rows = headings.select("trip_id", "sec", scalar.compass8(F.col(column)).alias("now"))

    def fold(trip: pd.DataFrame) -> pd.DataFrame:
        trip = trip.sort_values("sec")
        shown, streak, out = None, 0, []
        for now in trip["now"]:
            streak = 0 if shown is None or now == shown else streak + 1
            if shown is None or streak > hold:
                shown, streak = now, 0
            out.append(shown)
        return pd.DataFrame({"trip_id": trip["trip_id"], "sec": trip["sec"], "octant": out})

    return rows.groupBy("trip_id").applyInPandas(fold, "trip_id long, sec int, octant string")


def place_labels(cities: DataFrame, bounds: DataFrame, width: int, height: int, font_px: float) -> DataFrame:
    """(trip_id, rank, name, dx_pt, dy_pt): by rank, the first of four spots around the city whose box is inside the
    panel (1 px border) and on no placed label; NULL where none is."""
    # A letter's width and a line's height in font sizes, the spots beside a city, points per pixel.
    w = 0.62 * font_px * F.length("name")
    x = (F.col("lon") - F.col("min_lon")) / (F.col("max_lon") - F.col("min_lon")) * width
    y = (F.col("max_lat") - F.col("lat")) / (F.col("max_lat") - F.col("min_lat")) * height
    by_rank = Window.partitionBy("trip_id").orderBy(F.col("rank").asc_nulls_last(), F.col("name").asc_nulls_last())
    number = F.row_number().over(by_rank).alias("n")
    boxes = cities.join(bounds, "trip_id").select(F.col("trip_id").cast("long"), F.col("rank").cast("int"), "name", x.alias("x"), y.alias("y"), w.alias("w"), number)
    tall = 1.3 * font_px

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.zeros((0, 4))
        for batch in batches:
            dx_pt, dy_pt = [], []
            for x, y, w, n in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w", "n")), strict=True):
                if n == 1:  # the next panel
                    taken = np.zeros((0, 4))
                spots = np.array([(6, -tall - 4), (6, 4), (-6 - w, -tall - 4), (-6 - w, 4)])
                left, top = x + spots[:, 0], y + spots[:, 1]
                free = (left >= 1) & (top >= 1) & (left + w <= width - 1) & (top + tall <= height - 1)
                if len(taken):
                    over = (left[:, None] < taken[:, 2]) & (taken[:, 0] < left[:, None] + w) & (top[:, None] < taken[:, 3]) & (taken[:, 1] < top[:, None] + tall)
                    free &= ~over.any(1)
                pick = int(free.argmax()) if free.any() else None
                dx_pt.append(None if pick is None else spots[pick, 0] * 0.72)
                dy_pt.append(None if pick is None else -spots[pick, 1] * 0.72)
                if pick is not None:
                    taken = np.vstack([taken, [left[pick], top[pick], left[pick] + w, top[pick] + tall]])
            columns = [batch.column(c) for c in ("trip_id", "rank", "name")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dx_pt, pa.float64()), pa.array(dy_pt, pa.float64())], ["trip_id", "rank", "name", "dx_pt", "dy_pt"])

    return boxes.mapInArrow(fold, "trip_id long, rank int, name string, dx_pt double, dy_pt double")


def labelled(matches: DataFrame, extras: DataFrame) -> DataFrame:
    """Adds extras and the route label."""
    both = matches.join(extras, ["trip_id", "sec"], "left")
    label: Column = scalar.route_label(F.col("route_id"), F.col("cardinal"), F.col("extras"))
    return both.withColumn("label", label)
