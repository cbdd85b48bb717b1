"""Looking back along one global order without putting all rows in one partition.

Rows are windowed within buckets of time; what a row needs from an earlier bucket comes from a
table with one row for each bucket, which is small (an hour of a century: under a million rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_US = 3_600_000_000


def _bucketed(rows: DataFrame, us: str, bucket_us: int) -> DataFrame:
    return rows.withColumn("__bucket", F.floor(F.col(us) / F.lit(bucket_us)).cast("bigint"))


def carried(rows: DataFrame, value: Column, us: str, tie: str, name: str, inclusive: bool, bucket_us: int = BUCKET_US) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` up to the row (or before it), in order of ``us`` and ``tie``.

    Rows whose ``us`` is null get null. Equal ``us`` and ``tie`` are ordered at random.
    """
    timed = _bucketed(rows, us, bucket_us).withColumn("__value", value)
    inside = Window.partitionBy("__bucket").orderBy(us, tie).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    last = timed.where("__bucket IS NOT NULL AND __value IS NOT NULL").groupBy("__bucket").agg(F.max_by("__value", F.struct(us, tie)).alias("__last"))
    buckets = timed.where("__bucket IS NOT NULL").select("__bucket").distinct().join(last, "__bucket", "left")
    # One row for each bucket: a window over all of them is small whatever the number of rows.
    before = buckets.select(F.col("__bucket").alias("__b"), F.last("__last", ignorenulls=True).over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    within = timed.withColumn("__within", F.when(F.col("__bucket").isNotNull(), F.last("__value", ignorenulls=True).over(inside)))
    joined = within.join(before, within["__bucket"] == before["__b"], "left")
    return joined.select(*rows.columns, F.coalesce("__within", "__before").alias(name))


def previous(rows: DataFrame, us: str, tie: str, name: str, value: Column | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """``rows`` with the value (the time itself by default) of the row just before."""
    return carried(rows, F.col(us) if value is None else value, us, tie, name, False, bucket_us)
