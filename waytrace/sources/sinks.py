"""Exports: CSV tables, clip lists, GeoJSON, subtitles. Each is one ordered text, made at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waytrace import schemas
from waytrace.functions import scalar
from waytrace.functions.dimensions import ALIGNMENT


def write_track(track: DataFrame, path: str) -> None:
    rows = track.withColumns({"global_sec": F.round("global_sec", 3), "valid": F.col("valid").cast("int")})
    rows.select(*schemas.TRACK_COLUMNS, "row_seq").repartitionByRange(1, "row_seq").sortWithinPartitions("row_seq").drop("row_seq").write.mode("overwrite").csv(path, header=True)


def _write_trips(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A folder ``trip_id=`` for each trip, with one ordered file; trips are dealt over the tasks."""
    dealt = rows.select("trip_id", *columns, *[c for c in order if c not in columns]).repartition("trip_id").sortWithinPartitions("trip_id", *order)
    dealt.select("trip_id", *columns).write.mode("overwrite").partitionBy("trip_id").csv(path, header=True)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """The tracks of many trips, each in its own folder."""
    rows = tracks.withColumns({"global_sec": F.round("global_sec", 3), "valid": F.col("valid").cast("int")})
    _write_trips(rows, path, schemas.TRACK_COLUMNS, ["row_seq"])


def write_trip_spans(spans: DataFrame, path: str, text: str = "label") -> None:
    """start_sec, end_sec and a text of many trips, each in its own folder."""
    rows = spans.withColumns({c: F.round(c, 3) for c in ("start_sec", "end_sec")})
    _write_trips(rows, path, ["start_sec", "end_sec", text], ["start_sec", "end_sec"])


def write_spans(spans: DataFrame, path: str, text: str = "label") -> None:
    """start_sec, end_sec and a text, by start; an empty table has its header, too."""
    rows = spans.select(F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), text)
    rows.repartitionByRange(1, "start_sec").sortWithinPartitions("start_sec", "end_sec").write.mode("overwrite").csv(path, header=True)


def clip_list(clips: DataFrame) -> DataFrame:
    """(value) lines that name the kept clips in order."""
    quoted = F.replace(F.col("clip"), F.lit("'"), F.lit("'\\''"))
    return clips.orderBy("clip").select(F.concat(F.lit("file '"), quoted, F.lit("'")).alias("value"))


def write_geojson(roads: DataFrame, path: str) -> None:
    """Roads (route_id, route_type, geometry), by ``road_seq`` if they have one, as the lines of one FeatureCollection; the pieces are joined in order by ``read`` as text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("route_id", "route_type").alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"),
    )
    # a NULL row keeps the one task of an empty table
    start = roads.sparkSession.createDataFrame([(None, None)], "road_seq long, value string")
    seq = F.col("road_seq") if "road_seq" in roads.columns else F.lit(0)
    rows = start.unionByName(roads.select(seq.cast("long").alias("road_seq"), F.to_json(feature).alias("value")))
    body = rows.repartitionByRange(1, "road_seq").sortWithinPartitions("road_seq").select("value").mapInArrow(_collection, "value string")
    body.write.mode("overwrite").text(path)


def _collection(batches):
    import pyarrow as pa

    yield pa.RecordBatch.from_pydict({"value": ['{"type": "FeatureCollection", "features": [']})
    lead = ""
    for batch in batches:
        lines = [x for x in batch.column(0).to_pylist() if x is not None]
        if lines:
            yield pa.RecordBatch.from_pydict({"value": [("," if i or lead else "") + x for i, x in enumerate(lines)]})
            lead = ","
    yield pa.RecordBatch.from_pydict({"value": ["]}"]})


def ass_events(spans: DataFrame, info: DataFrame | None = None, titles: DataFrame | None = None, fade_ms: int = 500, title_fade_ms: int = 300) -> DataFrame:
    """(trip_id, stream, start_sec, value): dialogue lines of town labels, info texts and day titles.

    Labels of 0.05 s or less and others of 0.01 s or less are dropped; a line break in a label is a space."""
    start, end = scalar.ass_time(F.col("start_sec")), scalar.ass_time(F.col("end_sec"))

    def lines(rows: DataFrame, stream: int, layer: int, style: str, text, least: float) -> DataFrame:
        kept = rows.where(F.col("end_sec") - F.col("start_sec") > least)
        return kept.select("trip_id", F.lit(stream).alias("stream"), "start_sec", F.concat(F.lit(f"Dialogue: {layer},"), start, F.lit(","), end, F.lit(f",{style},,0,0,0,,"), text).alias("value"))

    faded = lambda ms, c: F.concat(F.lit(f"{{\\fad({ms},{ms})}}"), c)
    out = lines(spans, 0, 0, "Town", faded(fade_ms, F.replace(F.col("label"), F.lit("\n"), F.lit(" "))), 0.05)
    if info is not None:
        out = out.unionByName(lines(info, 1, 0, "Info", F.col("label"), 0.01))
    if titles is not None:
        out = out.unionByName(lines(titles, 2, 1, "DayTitle", faded(title_fade_ms, F.col("title")), 0.01))
    return out


def ass_header(font: str = "Arial", size: int = 48, position: str = "bottom_center", margin_v: int = 40, outline: int = 2, info_size: int = 26, info_margin_v: int = 8, title_size: int = 56, title_outline: int = 3, title_margin_v: int = 280) -> str:
    """Script information and the three styles."""
    # The script's header lines, the fields of a style and of an event.
    align = ALIGNMENT.get(position, 2)
    white, black, shade = "&H00FFFFFF", "&H00000000", "&H80000000"

    def style(name: str, points: int, bold: int, edge: int, where: int, margin: int) -> str:
        fields = [name, font, points, white, white, black, shade, bold, 0, 0, 0, 100, 100, 0, 0, 1, edge, 0, where, 40, 40, margin, 1]
        return "Style: " + ",".join(map(str, fields))

    names = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
    return "\n".join([
        "[Script Info]", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "",
        "[V4+ Styles]", "Format: " + names,
        style("Town", size, -1, outline, align, margin_v), style("Info", info_size, 0, max(outline - 1, 1), align, info_margin_v), style("DayTitle", title_size, -1, title_outline, 8, title_margin_v), "",
        "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", "",
    ])


def write_ass(events: DataFrame, path: str, header: str | None = None) -> None:
    """The subtitles of one trip as one text file in ``path``."""
    head = events.sparkSession.createDataFrame([(-1, 0.0, (header or ass_header()).removesuffix("\n"))], "stream int, start_sec double, value string")
    rows = head.unionByName(events.select("stream", "start_sec", "value"))
    rows.repartitionByRange(1, "stream").sortWithinPartitions("stream", "start_sec").select("value").write.mode("overwrite").text(path)
