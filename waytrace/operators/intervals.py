"""Spans over the video clock: run lengths, differences, masks, segments, fades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waytrace.functions import scalar


def with_breaks(labels: DataFrame, dark: DataFrame) -> DataFrame:
    """A blank label at the start of each dark span."""
    return labels.select("trip_id", "sec", "label").unionByName(dark.select("trip_id", F.col("start_sec").alias("sec"), F.lit("").alias("label")))


def run_lengths(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """(trip_id, start_sec, end_sec, label) of the runs of equal labels, by (sec, label): blank at a
    second stands first. A run ends where the next begins, the last at ``ends``.end_sec; blank runs only end others."""
    w = Window.partitionBy("trip_id").orderBy("sec", "label")
    changed = ~F.col("label").eqNullSafe(F.lag("label").over(w)) | (F.row_number().over(w) == 1)
    heads = labels.withColumn("_new", changed).where("_new")
    spans = heads.withColumn("_next", F.lead("sec").over(w)).join(ends.select("trip_id", F.col("end_sec").alias("_last")), "trip_id", "left")
    return spans.where("label <> ''").select("trip_id", F.col("sec").alias("start_sec"), F.coalesce("_next", "_last").alias("end_sec"), "label")


def disjoint(dark: DataFrame) -> DataFrame:
    """(trip_id, d_start, d_end): dark spans without what an earlier one covers; those that abut stay apart. One without length still cuts."""
    before = Window.partitionBy("trip_id").orderBy("start_sec", "end_sec").rowsBetween(Window.unboundedPreceding, -1)
    rows = dark.where("end_sec >= start_sec").withColumn("_reach", F.max("end_sec").over(before))
    open_ = rows.where("_reach IS NULL OR end_sec > _reach")
    return open_.select("trip_id", F.coalesce(F.greatest("start_sec", "_reach"), "start_sec").alias("d_start"), F.col("end_sec").alias("d_end"))


#: Seconds of a bucket in which spans and dark spans meet.
BUCKET_SECS = 600


def _bucketed(rows: DataFrame, start: str, end: str) -> DataFrame:
    first, last = (F.floor(F.col(c) / BUCKET_SECS) for c in (start, end))
    return rows.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def subtract(spans: DataFrame, dark: DataFrame, fill: str | None = None) -> DataFrame:
    """``spans`` (trip_id, start_sec, end_sec, label) without the dark parts, which become ``fill`` if it is given.

    Spans and dark spans of a trip meet by buckets of time. Equal spans are cut each on their own; spans without
    length go where a trip has dark spans."""
    order = Window.partitionBy("trip_id").orderBy("start_sec", "end_sec", "label")
    spans = spans.select("trip_id", "start_sec", "end_sec", "label").withColumn("_n", F.row_number().over(order))
    d = disjoint(dark)
    met = _bucketed(spans, "start_sec", "end_sec").join(_bucketed(d, "d_start", "d_end").withColumnRenamed("_first", "_first_dark"), ["trip_id", "_bucket"])
    hit = met.where((F.col("_bucket") == F.greatest("_first", "_first_dark")) & (F.col("d_start") < F.col("end_sec")) & (F.col("d_end") > F.col("start_sec")))
    hit = hit.withColumn("a", F.greatest("d_start", "start_sec")).withColumn("b", F.least("d_end", "end_sec"))
    w = Window.partitionBy("trip_id", "_n").orderBy("a", "b")
    hit = hit.withColumn("_from", F.coalesce(F.lag("b").over(w), F.col("start_sec"))).withColumn("_last", F.lead("a").over(w).isNull())
    piece = lambda s, e, label: F.struct(s.alias("s"), e.alias("e"), label.alias("t"))
    lit = F.array(piece(F.col("_from"), F.col("a"), F.col("label")), F.when(F.col("_last"), piece(F.col("b"), F.col("end_sec"), F.col("label"))))
    parts = F.filter(lit, lambda p: p.isNotNull() & (p["e"] > p["s"]))
    if fill:
        parts = F.concat(parts, F.array(piece(F.col("a"), F.col("b"), F.lit(fill))))
    cut = hit.select("trip_id", F.explode(parts).alias("_p")).select("trip_id", F.col("_p.s").alias("start_sec"), F.col("_p.e").alias("end_sec"), F.col("_p.t").alias("label"))
    trips = dark.select("trip_id").distinct().withColumn("_dark", F.lit(True))
    whole = spans.join(hit.select("trip_id", "_n").distinct(), ["trip_id", "_n"], "left_anti").join(trips, "trip_id", "left").where("_dark IS NULL OR end_sec > start_sec")
    return whole.select("trip_id", "start_sec", "end_sec", "label").unionByName(cut)


def dark_seconds(dark: DataFrame, totals: DataFrame) -> DataFrame:
    """(trip_id, sec) of the whole seconds that a dark span touches."""
    rows = dark.join(totals, "trip_id").withColumn("lo", F.greatest(F.lit(0), F.floor("start_sec"))).withColumn("hi", F.least(F.col("total_secs").cast("long"), F.ceil("end_sec")))
    return rows.where("hi > lo").select("trip_id", F.explode(F.sequence(F.col("lo").cast("int"), (F.col("hi") - 1).cast("int"))).alias("sec")).distinct()


def dark_mask(seconds: DataFrame, dark: DataFrame, totals: DataFrame) -> DataFrame:
    """``seconds`` with a boolean ``dark``."""
    marked = dark_seconds(dark, totals).withColumn("dark", F.lit(True))
    return seconds.join(marked, ["trip_id", "sec"], "left").withColumn("dark", F.coalesce("dark", F.lit(False)))


def islands(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the number, from 1, of the run of equal values (null safe) a second is in."""
    w = Window.partitionBy("trip_id").orderBy("sec")
    changed = (F.row_number().over(w) == 1) | ~F.col(column).eqNullSafe(F.lag(column).over(w))
    return rows.withColumn("_new", changed.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def day_segments(dates: DataFrame) -> DataFrame:
    """(trip_id, day_number, local_date, start_sec, end_sec): runs of one date; one that comes back is a new segment."""
    runs = islands(dates, "local_date", "day_number")
    return runs.groupBy("trip_id", "day_number").agg(F.first("local_date").alias("local_date"), F.min("sec").alias("start_sec"), (F.max("sec") + 1).alias("end_sec"))


def day_titles(segments: DataFrame, spans: DataFrame, display: float = 2.0, shortest: float = 2.0) -> DataFrame:
    """(trip_id, day_number, start_sec, end_sec, title) of the segments that are long enough and have a label; the others use up their number."""
    long = segments.where(F.col("end_sec") - F.col("start_sec") >= shortest)
    named = spans.where("label <> ''").select("trip_id", F.col("start_sec").alias("s"), F.col("end_sec").alias("e"), "label")
    near = long.join(named, "trip_id").where("e > start_sec AND s < end_sec")
    order = F.struct("s", "e", "label")
    ends = near.groupBy("trip_id", "day_number", "start_sec", "end_sec").agg(F.min_by("label", order).alias("_first"), F.max_by("label", order).alias("_last"))
    start, end = F.col("start_sec").cast("double"), F.col("end_sec").cast("double")
    return ends.select("trip_id", "day_number", start.alias("start_sec"), F.least(start + display, end).alias("end_sec"), scalar.day_title(F.col("day_number"), F.col("_first"), F.col("_last")).alias("title"))


def shield_alpha(matches: DataFrame, fade: int = 1, column: str = "route_id") -> DataFrame:
    """Adds ``alpha``: rising for ``fade`` seconds after a new route, falling after one is lost."""
    runs = islands(matches, column, "_island")
    age = F.row_number().over(Window.partitionBy("trip_id", "_island").orderBy("sec"))
    ramp = F.least(F.lit(1.0), age / F.lit(float(max(1, fade))))
    return runs.withColumn("alpha", F.when(F.col(column).isNotNull(), ramp).otherwise(1.0 - ramp)).drop("_island")


def segment_fade(rows: DataFrame, fade: int = 2) -> DataFrame:
    """Adds ``alpha`` to the seconds of day segments (trip_id, day_number, sec): 0 at inner edges, 1 from ``fade`` seconds on."""
    if fade <= 0:
        return rows.withColumn("alpha", F.lit(1.0))
    part = Window.partitionBy("trip_id", "day_number")
    i = F.row_number().over(part.orderBy("sec")) - 1
    placed = rows.withColumn("_i", i).withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_days", F.max("day_number").over(Window.partitionBy("trip_id")))
    ramp = F.greatest(F.lit(1), F.least(F.lit(fade), F.floor(F.col("_n") / 2)))
    rise = F.when(F.col("day_number") == 1, 1.0).otherwise(F.col("_i") / ramp)
    fall = F.when(F.col("day_number") == F.col("_days"), 1.0).otherwise((F.col("_n") - 1 - F.col("_i")) / ramp)
    return placed.withColumn("alpha", F.least(F.lit(1.0), rise, fall)).drop("_i", "_n", "_days")


def hide_dark(seconds: DataFrame, values: dict[str, Column]) -> DataFrame:
    """On dark seconds each named column becomes what ``values`` gives."""
    return seconds.withColumns({name: F.when(F.col("dark"), value).otherwise(F.col(name)) for name, value in values.items()})


def coverage(seconds: DataFrame) -> DataFrame:
    """Per trip: seconds on highways, on local roads, dark (columns highway_id, local_id, dark)."""
    return seconds.groupBy("trip_id").agg(
        F.count_if(F.col("highway_id").isNotNull()).alias("highway_secs"),
        F.count_if(F.col("highway_id").isNull() & F.col("local_id").isNotNull()).alias("local_secs"),
        F.count_if("dark").alias("dark_secs"),
        F.count(F.lit(1)).alias("total_secs"),
    )
