"""The three entry points as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waytrace.config import Settings
from waytrace.functions import formats, scalar
from waytrace.operators import intervals, matching, memo, resample, roads_prep, track as ops
from waytrace.sources import clips as clip_source, sinks

KEY = ["trip_id", "sec"]


def extract(files: DataFrame, manifest: DataFrame, places: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """From clips (clip, content) or their fixes (``clips.folder_fixes``), their durations (trip_id, clip, duration_sec) and a
    table of places: track, labels, gaps, clip list, durations and warnings. Clips without a duration are left out of everything."""
    offsets = ops.clip_offsets(manifest)
    raw = clip_source.read_fixes(files) if "content" in files.columns else files
    fixes = ops.on_video_clock(raw.join(manifest.select("trip_id", "clip"), "clip"), offsets)
    fixes = fixes.withColumn("ts", F.to_timestamp_ntz("timestamp_utc", F.lit("yyyy-MM-dd HH:mm:ss")))
    clip_no = F.dense_rank().over(_clips_in_order())
    fixes = fixes.withColumn("row_seq", clip_no.cast("long") * (1 << 31) + F.col("sec_in_clip"))
    track = ops.town_labels(ops.resolved_towns(ops.geocoded(fixes, places)), settings.labels_format)
    dark = ops.dark_spans(offsets, fixes)
    durations = ops.total_duration(manifest)
    labels = intervals.with_breaks(track.select("trip_id", F.col("global_sec").alias("sec"), "label"), dark)
    spans = intervals.run_lengths(labels, durations.select("trip_id", F.col("duration_sec").alias("end_sec")))
    return {
        "track": track,
        "labels": spans,
        "gaps": dark,
        "clip_list": sinks.clip_list(manifest),
        "durations": durations,
        "warnings": ops.time_gaps(track, settings.diagnostics_gap_warning_minutes),
    }


def _clips_in_order():
    from pyspark.sql import Window

    return Window.partitionBy("trip_id").orderBy("clip")


def overlay(
    track: DataFrame,
    labels: DataFrame,
    dark: DataFrame,
    durations: DataFrame,
    roads: DataFrame,
    local_roads: DataFrame | None = None,
    settings: Settings = Settings(),
    placeholder: str = "no GPS lock",
    kept: tuple[str, str, str] | None = None,
) -> dict[str, DataFrame]:
    """What the overlay shows: subtitle events, and for each second the place, the road, the info line and the compass.

    ``track`` has trip_id, row_seq, global_sec, ts, valid, lat, lon, speed_mph, heading and state.
    ``kept``: a folder and the digests (``memo.content_digest``) of the track's and the roads' files; road matches for these
    inputs and settings are then taken from the folder, or made and written there."""
    totals = resample.total_seconds(track, durations)
    # places, headings and speeds come from the same fix of a second
    seconds = resample.fill_seconds(track, totals, ["lat", "lon", "heading", "speed_mph"])
    spans = intervals.subtract(labels, dark)
    held = resample.fill_seconds(track, totals, ["state", "lon", "ts"])
    zone: Column = F.when(F.col("state") != "", scalar.zone_of(F.col("state"), F.col("lon")))
    dates = held.select(*KEY, scalar.local_date(F.col("ts"), zone, settings.info_utc_offset_adjust).alias("local_date"))
    days = intervals.day_segments(dates)
    titles = intervals.day_titles(days, spans, settings.day_title_display_secs, settings.day_title_min_duration_secs)
    points = ops.info_segments(track, settings.info_format, settings.info_speed_source, settings.info_utc_offset_adjust)
    info = intervals.subtract(ops.info_spans(points, durations), dark, placeholder)

    tolerance, freeze = settings.roads_match_tolerance_mi, settings.roads_freeze_below_mph

    def matches(kind: str, network: DataFrame, tolerance_mi: float, grace: int, extra: int = 0) -> DataFrame:
        make = lambda: matching.match_roads(seconds, network, tolerance_mi, grace, freeze, extra)
        if kept is None:
            return make()
        folder, track_digest, roads_digest = kept
        # the lengths of trips and the extra roads count as inputs, too
        whole = totals.agg(F.sum(F.xxhash64("trip_id", "total_secs").cast("decimal(38,0)"))).first()[0] or 0
        key = memo.match_key(track_digest, f"{roads_digest}|{kind}|{extra}", tolerance_mi, grace, int(whole), freeze)
        return memo.kept_table(track.sparkSession, folder, key, make)

    highway = matches("highway", roads, tolerance, settings.roads_match_grace_secs, settings.roads_concurrency_max_extra)
    if local_roads is None:
        matched = highway.withColumns({"highway_id": F.col("route_id"), "local_id": F.lit(None).cast("string")})
    else:
        # local roads freeze at the highways' speed
        local = matches("local", local_roads, settings.local_roads_match_tolerance_mi, settings.local_roads_match_grace_secs)
        matched = matching.merged_matches(highway, local)
    lines = resample.info_per_second(points, totals)
    turned = matching.compass(seconds, settings.compass_smoothing_secs, settings.compass_freeze_below_mph)
    octants = matching.debounced_octants(turned, "shown", settings.compass_hold_secs)
    strip = matched.join(lines, KEY, "left").join(turned.select(*KEY, F.col("shown").alias("compass")), KEY, "left").join(octants, KEY, "left")
    strip = intervals.shield_alpha(intervals.dark_mask(strip, dark, totals))
    none = F.lit(None)
    hidden = {
        "route_id": none.cast("string"),
        "cardinal": none.cast("string"),
        "extras": F.array().cast("array<string>"),
        "compass": none.cast("double"),
        "octant": none.cast("string"),
        "segments": F.array(F.struct(F.lit(placeholder).alias("text"), F.lit(False).alias("is_dim"))).cast(formats.SEGMENTS),
    }
    strip = intervals.hide_dark(strip, hidden)
    label = scalar.route_label(F.col("route_id"), F.col("cardinal"), F.col("extras"))
    return {
        "events": sinks.ass_events(spans, info, titles),
        "seconds": seconds,
        "strip": strip.withColumn("route_label", label),
        "days": days,
        "coverage": intervals.coverage(strip),
    }


def prepare_roads(track: DataFrame, shapes: DataFrame, counties: DataFrame, every: int = 20, pad_deg: float = 0.15) -> dict[str, DataFrame]:
    """Roads around a track, from shapes (state, county_code, RTTYP, MTFCC, FULLNAME, points, parts): highways by the states'
    boxes, local streets of the counties that sampled fixes fall into, by the same boxes."""
    boxes = roads_prep.state_boxes(track, pad_deg)
    box = F.struct("min_lat", "max_lat", "min_lon", "max_lon")
    inside = shapes.join(F.broadcast(boxes.select("state", box.alias("box"))), "state")  # one row per state
    touched = roads_prep.counties_of(ops.systematic_sample(track, every), counties)
    return {
        "boxes": boxes,
        "unknown_states": roads_prep.unknown_states(track),
        "highways": roads_prep.highway_roads(inside, F.col("box")),
        "locals": roads_prep.local_roads(inside.join(touched, "county_code", "left_semi"), F.col("box")),
    }
