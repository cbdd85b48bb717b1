"""Streams of photos and of progress, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(photos: DataFrame, gap_s: float, late_s: float) -> DataFrame:
    """(camera, first_at, last_at, photos) of each camera's runs of photos no more than ``gap_s`` apart, once complete.

    ``photos`` streams photo_id, camera and captured_at. A photo later than ``late_s`` is dropped. These are stretches
    of time; which photos of one are alike is for the batch operators.
    """
    timed = photos.where("captured_at IS NOT NULL").withWatermark("captured_at", f"{int(late_s * 1000)} milliseconds")
    w = F.session_window("captured_at", f"{int(gap_s * 1000)} milliseconds")
    return timed.groupBy("camera", w).agg(F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.count("*").alias("photos")).drop("session_window")


def latest_ticks(log: DataFrame) -> DataFrame:
    """(run_id, stage, seq, done): each stage's latest tick, kept up to date (output mode update or complete)."""
    return log.where("kind = 'tick'").groupBy("run_id", "stage").agg(F.max("seq").alias("seq"), F.max_by("done", "seq").alias("done"))


def into_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is, written once; ``checkpoint`` lies in a folder that all executors share."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
