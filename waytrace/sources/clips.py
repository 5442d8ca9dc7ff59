"""Telemetry in camera clips: chunks tagged ``freeGPS`` in the bytes of MP4 files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waytrace.schemas import FIX

# The tag of a chunk, its status marker, where that is looked for, and how far.
TAG = b"freeGPS"
STATUS = re.compile(rb"[AV][NS][EW]\x00")
FROM_BYTE, WINDOW = 24, 220
CLOCK, PLACE = struct.Struct("<6I"), struct.Struct("<4f")
MPH_PER_KNOT = 1.15078


def _degrees(value: float, hemisphere: bytes) -> float:
    whole = int(value / 100)
    angle = whole + (value - 100 * whole) / 60
    return round(-angle if hemisphere in b"SW" else angle, 6)


def fixes_in(data: bytes) -> Iterator[tuple]:
    """(sec_in_clip, timestamp_utc, valid, lat, lon, speed_mph, heading) of each whole chunk; void ones count as seconds, too."""
    sec = 0
    for tag in re.finditer(TAG, data):
        chunk = data[tag.start() : tag.start() + WINDOW]
        status = STATUS.search(chunk, FROM_BYTE)
        if status is None or len(chunk) < status.start() + 4 + PLACE.size:
            continue
        at = status.start()
        hour, minute, second, year, month, day = CLOCK.unpack_from(chunk, at - CLOCK.size)
        lat, lon, knots, heading = PLACE.unpack_from(chunk, at + 4)
        state, north, east = (chunk[at + i : at + i + 1] for i in range(3))
        yield sec, f"20{year:02d}-{month:02d}-{day:02d} {hour:02d}:{minute:02d}:{second:02d}", state == b"A", _degrees(lat, north), _degrees(lon, east), round(knots * MPH_PER_KNOT, 1), round(heading, 1)
        sec += 1


def clip_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each clip in a folder (not below it), once: path, clip (name), length. The bytes aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{MP4,mp4}").load(folder).select("path", "length")
    return files.withColumn("clip", F.element_at(F.split("path", "/"), -1))


def _named(file_name: Column) -> Column:
    """A file's name as it is in the folder; in ``_metadata`` it is percent-encoded."""
    return F.url_decode(F.replace(file_name, F.lit("+"), F.lit("%2B")))


def folder_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(clip, chunk_no, chunk): the bytes from each tag on, of the clips in a folder (not below it).

    Clips are read as texts whose lines end in the tag, so a large file is read in splits by many tasks; only the first bytes of
    a line leave the scan. A line without a tag of more than 2 GB is refused by Hadoop's reader."""
    texts = spark.read.option("lineSep", TAG.decode()).option("pathGlobFilter", "*.{MP4,mp4}").text(folder)
    heads = texts.select(
        _named(F.col("_metadata.file_name")).alias("clip"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
        F.substring(F.col("value").cast("binary"), 1, WINDOW - len(TAG)).alias("head"),
    )
    in_file = Window.partitionBy("clip").orderBy("at", "line")
    # a chunk may reach over the tags behind it; what lies before the first tag of a file isn't one
    tags = WINDOW // len(TAG)
    following = F.collect_list("head").over(in_file.rowsBetween(Window.currentRow, tags))
    joined = F.aggregate(following, F.lit(b""), lambda whole, head: F.concat(whole, F.lit(TAG), head))
    numbered = heads.select("clip", (F.row_number().over(in_file) - 1).alias("chunk_no"), F.substring(joined, 1, WINDOW).alias("chunk"))
    return numbered.where("chunk_no > 0")


def folder_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes of all clips in a folder, as ``read_fixes`` finds them."""
    return _numbered(folder_chunks(spark, folder).mapInArrow(_runner(True), CHUNK_FIX))


def _numbered(fixes: DataFrame) -> DataFrame:
    """Whole chunks are the seconds of a clip."""
    second = F.row_number().over(Window.partitionBy("clip").orderBy("chunk_no")) - 1
    return fixes.withColumn("sec_in_clip", second.cast("int")).select(*[f.split()[0] for f in FIX.split(", ")])


def read_fixes(clips: DataFrame) -> DataFrame:
    """The fixes of clips (clip, content) whose bytes are in the table, a clip at a time."""
    return clips.select("clip", "content").mapInArrow(_runner(False), FIX)


CHUNK_FIX = FIX.replace("sec_in_clip int", "chunk_no int")


def _runner(single: bool):
    """Fixes of batches of clips (clip, content), or of single chunks (clip, chunk_no, chunk), which keep their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in (CHUNK_FIX if single else FIX).split(", ")]
        types = [pa.string(), pa.int32(), pa.string(), pa.bool_(), *[pa.float64()] * 4]
        for batch in batches:
            if single:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                found = [(clip, no, *fix[1:]) for clip, no, data in rows for fix in islice(fixes_in(data), 1)]
                parts = [found] if found else []
            else:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                parts = filter(None, ([(clip, *fix) for fix in fixes_in(content.as_py() or b"")] for clip, content in pairs))
            for found in parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return run
