"""Results kept by content: whole tables by a digest of their inputs, points by their quantised place."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.functions import scalar


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="waytrace-")
        sc.setCheckpointDir(path)
    return path


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again, so what follows doesn't make them anew."""
    path = f"{shared_folder(rows.sparkSession)}/waytrace-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def content_digest(spark: SparkSession, path: str) -> str:
    """A digest of the files below ``path``: of their names' order and their bytes; files are hashed where they lie."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d"))
    return hashlib.sha256("|".join(r.d for r in files.orderBy("path").collect()).encode()).hexdigest()


def match_key(track_digest: str, roads_digest: str, tolerance_mi: float, grace: int, total_secs: int, freeze_mph: float) -> str:
    return hashlib.sha256("|".join(map(str, (track_digest, roads_digest, tolerance_mi, grace, total_secs, freeze_mph))).encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def kept_table(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``folder``/key=``key``; made and written if it can't be read."""
    path = f"{folder}/key={key}"
    held = _read(spark, path)
    if held is None:
        make().write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path)
    return held


def kept_points(points: DataFrame, folder: str, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results per quantised point (column ``point``): only points that aren't kept are made, then appended.

    ``make`` gets (point, lat, lon), lat and lon being the quantised ones, so the order of arrival decides nothing."""
    path = f"{folder}/key={key}"
    wanted = points.select(F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")).distinct().withColumn("point", scalar.quantized_point(F.col("lat"), F.col("lon")))
    held = _read(points.sparkSession, path)
    new = wanted if held is None else wanted.join(held.select("point"), "point", "left_anti")
    make(new).write.mode("append").parquet(path)
    return points.sparkSession.read.parquet(path).join(wanted.select("point"), "point", "left_semi")
