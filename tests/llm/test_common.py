"""Skewed joins, ranges of ids, staged tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from waytrace.llm import common, packing, secret_ledger, simhash


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(1, f"a{i}") for i in range(50)] + [(k, "b") for k in range(2, 12)] + [(None, "n")], "k long, v string")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 8)], "k long, w long")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.skew_join(left, right, "k", how).select("k", "v", "w").collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=repr)
    assert common.skew_join(left.limit(0), right, "k", "left").count() == 0


def test_ranges(spark):
    ids = spark.createDataFrame([(int(i),) for i in np.random.default_rng(1).permutation(1000)] + [(None,)], "id long")
    bounds = common.id_bounds(ids, "id", 10)
    assert bounds == common.id_bounds(ids.repartition(7), "id", 10)
    rows = common.with_range(ids, "id", bounds, "part").collect()
    assert len({r.part for r in rows}) == 11
    assert max(r.part for r in rows if r.id is not None) < next(r.part for r in rows if r.id is None)
    order = sorted((r.id, r.part) for r in rows if r.id is not None)
    assert [p for _, p in order] == sorted(p for _, p in order)
    assert common.id_bounds(ids.limit(0), "id", 10) == []


def test_staged_and_prefix(spark):
    rows = common.staged(spark.range(5).withColumn("_w", F.lit(1)), "t")
    assert rows.count() == 5
    assert common.staged(rows.limit(0), "t").columns == ["id", "_w"]
    assert common.free_prefix(rows) == "_w_"


def test_runs():
    sizes = np.array([3, 4, 50, 1, 1])
    assert list(common.runs(sizes, 8)) == [(0, 2), (2, 3), (3, 5)]
    assert list(common.runs(np.zeros(0, int), 8)) == []


def test_local_table(spark, tmp_path):
    rows = common.local_table(spark, [(1, [2, 3]), (None, [])], "a long, b array<long>")
    assert rows.dtypes == [("a", "bigint"), ("b", "array<bigint>")]
    assert [tuple(r) for r in rows.collect()] == [(1, [2, 3]), (None, [])]
    assert secret_ledger.entries_in(spark, str(tmp_path / "none")).count() == 0
    for df in (rows, secret_ledger.entries_in(spark, str(tmp_path / "none"))):  # no rows that come through Python workers
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()


def test_text_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    sizes = spark.range(0, 5000, 1, 1).mapInArrow(largest, "n long")
    with common.text_batches(spark):
        assert max(r.n for r in sizes.collect()) == common.BATCH_ROWS
    assert spark.conf.get(conf) == before
    spark.conf.set(conf, 7)
    try:
        with common.text_batches(spark):
            assert spark.conf.get(conf) == "7"
        assert spark.conf.get(conf) == "7"
    finally:
        spark.conf.set(conf, before)


def test_workers_forget(odd, monkeypatch):
    """A worker that packed keeps its tokenizer for the next task of packing, not for those of other operators."""
    runs = []
    monkeypatch.setattr(type(odd), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    packing.pieces_of(odd)
    simhash.fingerprints(odd)
    pack, mark = runs
    texts = pa.array(["Some words.", None])
    for _ in range(2):
        assert sum(b.num_rows for b in pack(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), texts], names=["doc_id", "text"])]))) == 2
        assert len(packing._TOKENIZERS) == 1
    assert sum(b.num_rows for b in mark(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), texts], names=["doc_id", "row", "text"])]))) == 2
    assert not packing._TOKENIZERS
