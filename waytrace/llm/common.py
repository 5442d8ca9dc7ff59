"""What the text operators share: table reads, staged tables, Arrow text buffers, what workers keep."""

from __future__ import annotations

import bisect
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step looks at; a longer text is cut into segments.
SEGMENT_BYTES = 1 << 20
#: Rows with whole texts that an executor and a worker hold at once, where ``text_batches`` is in force.
BATCH_ROWS = 1024
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What operators keep in a worker from task to task, by operator.
KEPT: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="waytrace-")
        sc.setCheckpointDir(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there,
    so a lost executor costs a reread, and later steps see the same rows each time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waytrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's ``rows``, held by the plan itself. A list given to ``createDataFrame`` passes through Python on the
    executors, which start workers of another kind for it that stay beside those of the operators."""
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile pass ``BATCH_ROWS`` rows at a time to Python, or fewer if the session says so."""
    before = spark.conf.get(_ROWS_CONF, None)
    if before is None or not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, BATCH_ROWS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS_CONF)
        else:
            spark.conf.set(_ROWS_CONF, before)


def kept(owner: str) -> dict:
    """What the operator ``owner`` keeps in this worker."""
    return KEPT.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system, which allocators otherwise hold for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def forget_others(owner: str) -> None:
    """Drop what operators other than ``owner`` keep in this worker."""
    held = [v for k, v in KEPT.items() if k != owner and v]
    for v in held:
        v.clear()
    if held:
        give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, by the operator ``owner``. Workers outlive their tasks and share an executor's memory with
    its JVM, so what others kept goes before and what the task freed goes back after."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        yield from run(batches)
        give_back()

    return lean_run


#: Rows from which on a join key may count as hot, and the share of all rows that makes it one.
HOT_ROWS = 1000
HOT_SHARE = 1000


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: str | None = None) -> DataFrame:
    """``left`` joined (inner or left) to ``right``, which has a key once; a key that holds many rows of ``left`` isn't shuffled.

    Keys with more than a ``HOT_SHARE``-th of the rows (and ``HOT_ROWS``) are fewer than ``HOT_SHARE``: their rows of
    ``right`` are broadcast. The other rows meet by a shuffle. Both tables are read twice, so they should be staged.
    ``counts``: a column of ``right`` that says how many rows of ``left`` have the key, if it is known."""
    if counts:
        total = right.agg(F.coalesce(F.sum(counts), F.lit(0))).first()[0]
        hot = right.where(F.col(counts) > max(HOT_ROWS, total // HOT_SHARE)).select(F.col(key).alias("_hot"))
    else:
        limit = max(HOT_ROWS, left.count() // HOT_SHARE)
        hot = left.groupBy(key).count().where(F.col("count") > limit).select(F.col(key).alias("_hot"))
    hot = staged(hot, "hot")
    few = F.broadcast(hot)
    held = right.join(few, F.col(key) == F.col("_hot"), "left_semi")
    often = left.join(few, F.col(key) == F.col("_hot"), "left_semi").join(F.broadcast(held), key, how)
    return often.unionByName(left.join(few, F.col(key) == F.col("_hot"), "left_anti").join(right, key, how))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for helper columns beside those of a table."""
    prefix = "_w"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value; null is empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of consecutive rows of about ``most`` bytes together (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: Ids that a sample for range bounds holds for each range, about.
IDS_A_RANGE = 8


def id_bounds(df: DataFrame, column: str, parts: int) -> list[float]:
    """Increasing inner bounds that cut the distinct ids into about equal ranges, from a sample that the ids alone decide."""
    ids = df.select(F.col(f"`{column}`").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    every = max(1, ids.count() // max(2000, IDS_A_RANGE * parts))
    sample = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).collect())
    return sorted({float(sample[len(sample) * i // parts]) for i in range(1, parts)}) if sample else []


def with_range(df: DataFrame, column: str, bounds: list[float], name: str) -> DataFrame:
    """``df`` with the number of the range its id falls in; null ids have the last number of all."""
    from pyspark.ml.feature import Bucketizer

    placed = df.withColumn("_place", F.col(f"`{column}`").cast("double"))
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_place", outputCol="_range", handleInvalid="keep").transform(placed)
    return dealt.withColumn(name, F.coalesce(F.col("_range").cast("int"), F.lit(len(splits) - 1))).drop("_place", "_range")


def id_ranges(df: DataFrame, column: str, parts: int, rows: int) -> tuple[list[float], DataFrame, int]:
    """Bounds of about ``parts`` ranges of ids; a table (range, base, cuts) of those ranges; and how many parts there are.

    An id (or null) with more than ``rows`` rows has a range of its own, which ``part_number`` cuts into ``cuts`` parts by a hash. There are
    fewer such ids than ranges, so they fit where the bounds do."""
    key = F.col(f"`{column}`").cast("long").alias("id")
    hot = {r.id: r["count"] for r in df.select(key).groupBy("id").count().where(F.col("count") > 2 * rows).collect()}
    own = {float(i + d) for i in hot if i is not None for d in (0, 1)}
    bounds = sorted({*id_bounds(df, column, parts), *own}) or [0.0]
    cuts = [1] * (len(bounds) + 2)
    for i, n in hot.items():
        at = len(bounds) + 1 if i is None else bisect.bisect_right(bounds, float(i))
        cuts[at] = -(-n // rows)
    base, table = 0, []
    for number, n in enumerate(cuts):
        table.append((number, base, n))
        base += n
    return bounds, local_table(df.sparkSession, table, "_number int, _base int, _cuts int"), base


def part_number(df: DataFrame, column: str, ranges: tuple[list[float], DataFrame, int], tie: Column, name: str) -> DataFrame:
    """``df`` with its part: rising with the id (null last), then with the 64-bit hash ``tie``."""
    placed = with_range(df, column, ranges[0], "_number").withColumn("_tie", F.shiftright(tie, 32) + F.lit(1 << 31))
    cut = F.floor(F.col("_tie") * F.col("_cuts") / F.lit(1 << 32)).cast("int")
    return placed.join(F.broadcast(ranges[1]), "_number").withColumn(name, F.col("_base") + cut).drop("_number", "_base", "_cuts", "_tie")
