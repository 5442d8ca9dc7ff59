"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the
columns of ``documents``.

1. quality classifier: rejected documents go.
2. SimHash near-dedup: of each group one document stays. Five-word shingles with a
   similarity of 0.8 or more: the trees find pairs within ``RADIUS`` bits, shards by minimum hashes the others.
3. secret scans: what the rules find is masked.
4. mixing: whole documents are taken as often as their source's target wants.
5. packing: the place of each piece of each document in sequences of 2048 ids.

Each stage works on all rows of the one before. Columns named like helpers of an operator don't clash; null text, very long text, repeated rows and empty tables are
what the operators say. The jobs that a stage runs itself pass small batches of texts to Python. The stages depend on a trained scorer and on tokenizer files, which
SQL can't express: ORACLE_SQL is None.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waytrace.llm import mixing, packing, quality, secret_ledger, simhash
from waytrace.llm.common import shared_dir, table, text_batches

SHINGLE = 5
SIMILARITY = 0.8
#: Bits within which the trees find pairs; links don't depend on it.
RADIUS = 3


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return quality.keep_good(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return simhash.keep_one(docs, SHINGLE, RADIUS, SIMILARITY)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return secret_ledger.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with text_batches(spark):
        return packing.pack(docs)


STAGES = [
    ("quality classifier", classified),
    ("simhash near-dedup", deduplicated),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/waytrace-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        rows = stage(spark, docs, sf_dir)
        with text_batches(spark):
            rows.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
