"""Session helpers: shared checkpoint folder and table readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="burstframe-")
    sc.setCheckpointDir(folder)
    return folder


_written: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the table.

    A table's size is known, whereas a checkpoint carries on the estimate of the plan it came
    from, which joins multiply: in a loop the number itself soon takes longer than the work.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for names in _written:
        names.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` writes inside is deleted at the end; so results must be stored before."""
    _written.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _written.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(keys: DataFrame, by: str, rows: int) -> DataFrame:
    """``keys`` dealt to tasks of about ``rows`` rows, and to as many as the cluster has cores at least: a small file is one task, however
    much work each of its rows stands for."""
    n, cores = keys.count(), keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(1, min(n, cores), -(-n // rows)), by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
