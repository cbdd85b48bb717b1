"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's ``docs``. All but the last keep the columns of ``docs``, whatever they are named besides
doc_id and text. An empty table stays empty; texts are taken whole, however long.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from burstframe.llm import decontam, packing, pii, quality, simhash
from burstframe.session import ensure_checkpoint_dir, scratch, table


#: Rows that go to a Python worker at once; Spark's 10,000 of whole texts take much memory on both sides.
ROWS_AT_ONCE = 2000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session that hands over at most ROWS_AT_ONCE rows. The setting stays, since the result is computed later."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        if now <= 0 or now > ROWS_AT_ONCE:
            spark.conf.set(name, ROWS_AT_ONCE)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees reject go; so do null texts and those without words."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of least doc_id; null ids and texts stay."""
    return simhash.deduplicate(docs)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; null and empty texts stay, rows that repeat are judged each."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers and secrets are replaced by their kind; null and empty texts stay as they are, and no row goes."""
    return pii.masked(docs, pii.detector(docs))


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each training sequence, with its tokens and the documents they are of; a null text is in none, an empty one is its end alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packed),
]

#: The trees, the fingerprints and the pattern graph can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table lies in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
