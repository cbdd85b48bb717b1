"""The plan of a run: which photos are picked, where each goes, and what a review changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import destination


def planned(groups: DataFrame, burst_picks: DataFrame, composition_picks: DataFrame | None = None) -> DataFrame:
    """(photo_id, verdict, folder_id, composed) for every photo of ``groups`` (group_id, photo_id).

    With compositions (a table with rows), picked is what they keep and all else is rejected, unscored photos
    too. Otherwise picked is what the bursts keep, and all photos of a burst without any score.
    """
    pool = groups.select("group_id", "photo_id")
    if composition_picks is not None and not composition_picks.isEmpty():
        kept = composition_picks.where("verdict = 'kept'").select("photo_id", F.col("composition_id").alias("folder_id")).dropDuplicates(["photo_id"])
        out = pool.join(kept, "photo_id", "left")
        return out.select("photo_id", F.when(F.col("folder_id").isNotNull(), "picked").otherwise("rejected").alias("verdict"), "folder_id", F.lit(True).alias("composed"))
    judged = burst_picks.select("group_id", "photo_id", F.col("verdict").alias("v"))
    some = judged.select("group_id").distinct().withColumn("scored", F.lit(True))
    out = pool.join(judged, ["group_id", "photo_id"], "left").join(some, "group_id", "left")
    picked = F.col("scored").isNull() | F.coalesce(F.col("v") == "kept", F.lit(False))
    return out.select("photo_id", F.when(picked, "picked").otherwise("rejected").alias("verdict"), F.when(picked, F.col("group_id")).alias("folder_id"), F.lit(False).alias("composed"))


def with_destination(plan: DataFrame, photos: DataFrame) -> DataFrame:
    """(photo_id, verdict, dest) of the planned photos that have a path."""
    paths = photos.where("path IS NOT NULL").select("photo_id", "path")
    return plan.join(paths, "photo_id").select("photo_id", "verdict", destination(F.col("verdict"), F.col("composed"), F.col("folder_id"), F.col("path")).alias("dest"))


def reviewed(picks: DataFrame, overrides: DataFrame) -> DataFrame:
    """(photo_id, keep): verdicts with those of overridden photos turned round. Kept and dropped complement each other."""
    turned = overrides.where("photo_id IS NOT NULL").select(F.col("photo_id").alias("o")).distinct()
    out = picks.join(turned, picks["photo_id"] == turned["o"], "left")
    return out.select("photo_id", ((F.col("verdict") == "kept") != F.col("o").isNotNull()).alias("keep"))


def deletions(plan: DataFrame, photos: DataFrame) -> DataFrame:
    """(photo_id, path): what applying the plan deletes, the rejected photos that have a path. Nothing is deleted here."""
    return plan.where("verdict = 'rejected'").select("photo_id").join(photos.where("path IS NOT NULL").select("photo_id", "path"), "photo_id")
