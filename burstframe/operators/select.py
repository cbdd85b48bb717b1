"""Scores within groups, and which photos of a group stay.

``members`` has group_id, photo_id, us, exposure, wb, sharpness_raw, noise, aesthetic, composition and faces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CullConfig
from ..functions.scores import PARTS, clamp, face_bonus, scene, standing, weight

CLOSE, STEP, AUTO_MOST = 0.92, 0.05, 5


def scored(members: DataFrame, config: CullConfig = CullConfig(), group: str = "group_id") -> DataFrame:
    """(group, photo_id, us, scene, sharpness, tech, aesthetic, composition, face_bonus, value) of the members
    that have all four technical signals; others are unscored and left out.

    Sharpness, and that of all faces together, counts by its z-score within the group; alone it is 0.5.
    Missing aesthetic and composition count 0.5, missing faces as none.
    """
    known = members.where("exposure IS NOT NULL AND wb IS NOT NULL AND sharpness_raw IS NOT NULL AND noise IS NOT NULL")
    known = known.withColumn("faces", F.coalesce("faces", F.array().cast(members.schema["faces"].dataType)))
    w = Window.partitionBy(group)
    sharp = F.filter(F.transform("faces", lambda f: f["sharpness"].cast("double")), lambda s: s.isNotNull())
    # Moments of the pool of faces from each photo's own: no second shuffle, no exploded rows.
    own = known.withColumns({"__n": F.size(sharp), "__s": F.aggregate(sharp, F.lit(0.0), lambda a, x: a + x)})
    pool = own.withColumns({"__members": F.count("*").over(w), "__mean": F.avg("sharpness_raw").over(w), "__dev": F.stddev_pop("sharpness_raw").over(w), "__faces": F.sum("__n").over(w), "__pool": F.sum("__s").over(w)})
    pool = pool.withColumn("__middle", F.col("__pool") / F.nullif(F.col("__faces"), F.lit(0)))
    pool = pool.withColumn("__square", F.aggregate(sharp, F.lit(0.0), lambda a, x: a + (x - F.col("__middle")) * (x - F.col("__middle"))))
    pool = pool.withColumn("__spread", F.sqrt(F.sum("__square").over(w) / F.nullif(F.col("__faces"), F.lit(0))))
    normal = lambda s: F.when(s.isNotNull(), F.when(F.col("__faces") >= 2, standing(s, F.col("__middle"), F.col("__spread"))).otherwise(0.5))
    faces = F.transform("faces", lambda f: f.withField("sharpness", normal(f["sharpness"].cast("double"))))
    pool = pool.withColumns({"__faces_now": faces, "sharpness": F.when(F.col("__members") == 1, F.lit(0.5)).otherwise(standing(F.col("sharpness_raw"), F.col("__mean"), F.col("__dev")))})
    # Columns of their own, so that they aren't worked out again for each weight.
    pool = pool.withColumns({"__count": F.size("__faces_now"), "__largest": F.coalesce(F.array_max(F.transform("__faces_now", lambda f: f["area"])), F.lit(0.0))})
    count, largest = F.col("__count"), F.col("__largest")
    tech = clamp(config.w_exposure * F.col("exposure") + config.w_wb * F.col("wb") + config.w_sharpness * F.col("sharpness") + config.w_noise * F.col("noise"))
    out = pool.select(
        group, "photo_id", "us", scene(count, largest).alias("scene"), "sharpness", tech.alias("tech"),
        F.coalesce("aesthetic", F.lit(0.5)).alias("aesthetic"), F.coalesce("composition", F.lit(0.5)).alias("composition"), face_bonus(F.col("__faces_now")).alias("face_bonus"),
        *(weight(p, count, largest).alias(f"__w_{p}") for p in PARTS),
    )
    value = clamp(sum((F.col(f"__w_{p}") * F.col("face_bonus" if p == "face" else p) for p in PARTS), F.lit(0.0)))
    return out.withColumn("value", value).drop(*(f"__w_{p}" for p in PARTS))


def _order() -> list[Column]:
    """Best first; a value that is no number comes last, then the earlier photo is first, then the lesser id."""
    return [F.when(F.isnan("value"), F.lit(float("-inf"))).otherwise(F.col("value")).desc(), F.col("us").asc_nulls_last(), F.col("photo_id")]


def ranked(scores: DataFrame, group: str = "group_id") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*_order())))


def top_k(scores: DataFrame, k: int, group: str = "group_id") -> DataFrame:
    """``scores`` with rank and verdict: the first ``k`` of each group are kept, the others rejected."""
    return ranked(scores, group).withColumn("verdict", F.when(F.col("rank") <= k, "kept").otherwise("rejected"))


def top_auto(scores: DataFrame, group: str = "group_id") -> DataFrame:
    """Like ``top_k``, as many as scores suggest: down to the first that falls below CLOSE of the best or
    drops by more than STEP of it from the one before, and at most AUTO_MOST."""
    w = Window.partitionBy(group).orderBy(*_order())
    best = F.greatest(F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1e-6))
    before = F.lag("value").over(w)
    fine = before.isNull() | ((F.col("value") / best >= CLOSE) & ((before - F.col("value")) / best <= STEP))
    run = scores.withColumns({"rank": F.row_number().over(w), "__fine": fine.cast("int")})
    kept = (F.min("__fine").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1) & (F.col("rank") <= AUTO_MOST)
    return run.withColumn("verdict", F.when(kept, "kept").otherwise("rejected")).drop("__fine")


def select(scores: DataFrame, k: int | None, group: str = "group_id") -> DataFrame:
    return top_k(scores, k, group) if k else top_auto(scores, group)


def top_technical(scores: DataFrame, k: int, group: str = "group_id") -> DataFrame:
    """Like ``top_k``, by the technical score alone."""
    return top_k(scores.withColumn("value", F.col("tech")), k, group)
