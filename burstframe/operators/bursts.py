"""Bursts: photos close in time and alike, as connected components.

``photos`` has photo_id, us (microseconds, null if unknown) and burst_id; ``features`` has
photo_id, embedding (unit length, or null) and phash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CullConfig
from ..functions.scores import PORTRAIT_AREA, bias, shifted
from ..functions.vectors import dot, hamming, sketch, surely_above
from ..session import cut
from .components import connected_components
from .timeline import carried, previous


def gap_s(earlier: Column, later: Column) -> Column:
    """Seconds between, of whole milliseconds."""
    return F.floor((later - earlier) / 1000) / 1000.0


def adaptive_gap(photos: DataFrame, config: CullConfig = CullConfig()) -> DataFrame:
    """One row, delta_s: the median gap times ``time_k``, within bounds; without gaps the median counts as 2 s."""
    gaps = previous(photos.where("us IS NOT NULL").select("photo_id", "us"), "us", "photo_id", "before").where("before IS NOT NULL")
    # Counted first: the exact median then handles distinct gaps, not photos.
    counted = gaps.groupBy(gap_s(F.col("before"), F.col("us")).alias("gap")).agg(F.count("*").alias("n"))
    median = F.coalesce(F.percentile("gap", 0.5, F.col("n")), F.lit(2.0))
    return counted.agg(F.least(F.greatest(config.time_k * median, F.lit(config.min_dt)), F.lit(config.max_dt)).alias("delta_s"))


def candidates(photos: DataFrame, delta_s: float) -> DataFrame:
    """(a, b): pairs of photos at most ``delta_s`` apart, ``a`` before ``b``.

    Times are cut into stretches of that length, so a pair lies in one stretch or in two that adjoin:
    an equality join, whose work follows the number of pairs.
    """
    width = max(1, int(delta_s * 1e6) + 1000)
    timed = photos.where("us IS NOT NULL").select("photo_id", "us").withColumn("slot", F.floor(F.col("us") / F.lit(width)).cast("bigint"))
    a = timed.select(F.col("photo_id").alias("a"), F.col("us").alias("a_us"), "slot")
    b = timed.select(F.col("photo_id").alias("b"), F.col("us").alias("b_us"), F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"))
    later = (F.col("b_us") > F.col("a_us")) | ((F.col("b_us") == F.col("a_us")) & (F.col("b") > F.col("a")))
    return a.join(b, "slot").where(later & (gap_s(F.col("a_us"), F.col("b_us")) <= delta_s)).select("a", "b")


def similar_edges(photos: DataFrame, features: DataFrame, delta_s: float, similarity: float, distance: int) -> DataFrame:
    """Candidates that are alike. A photo without features has no edge.

    Sketches of two bytes a number go to the pairs and decide nearly all; the vectors themselves go only to pairs
    whose cosine is so near to ``similarity`` that sketches can't tell, so the edges are those of the vectors.
    """
    f = features.select("photo_id", "embedding", "phash")
    v = F.col("embedding")
    small = f.select("photo_id", sketch(v).alias("sketch"), F.when(v.isNotNull(), F.size(v)).alias("width"), "phash")
    left, right = (small.withColumnsRenamed({"photo_id": s, "sketch": f"{s}_sketch", "width": f"{s}_width", "phash": f"{s}_hash"}) for s in "ab")
    pairs = candidates(photos, delta_s).join(left, "a").join(right, "b").withColumn("told", surely_above(F.col("a_sketch"), F.col("b_sketch"), similarity))
    both = F.coalesce(F.col("a_width") == F.col("b_width"), F.lit(False))
    told = F.when(both, F.col("told")).otherwise(F.coalesce(hamming(F.col("a_hash"), F.col("b_hash")) <= distance, F.lit(False)))
    # A filter on the verdict would work it out again; this gives no row for a false one.
    judged = cut(pairs.select("a", "b", F.explode(F.filter(F.array(told), lambda x: x.isNull() | x)).alias("told")))
    doubt = judged.where("told IS NULL").select("a", "b")
    sure = judged.where("told").select("a", "b")
    if doubt.isEmpty():
        return sure
    asked = cut(doubt.select(F.explode(F.array("a", "b")).alias("photo_id")).distinct())
    # As a condition it is met before vectors are made, where features are worked out on the way.
    whole = cut(f.sparkSession.sql("SELECT photo_id, embedding FROM {f} WHERE photo_id IN (SELECT photo_id FROM {asked})", f=f, asked=asked))
    x, y = (whole.withColumnsRenamed({"photo_id": s, "embedding": f"{s}_vec"}) for s in "ab")
    return sure.unionByName(doubt.join(x, "a").join(y, "b").where(dot(F.col("a_vec"), F.col("b_vec")) > similarity).select("a", "b"))


def forced_edges(photos: DataFrame, delta_s: float) -> DataFrame:
    """Successive photos of one burst_id, unless a photo of another lies between them and more than
    ``delta_s`` after the first: looking for partners ends there. Those before the first would have
    ended there too, so successive pairs connect all that must be.
    """
    timed = photos.where("us IS NOT NULL").select("photo_id", "us", "burst_id")
    marked = previous(timed, "us", "photo_id", "p", F.struct("us", "burst_id"))
    starts = F.when(F.col("p").isNotNull() & ~F.col("burst_id").eqNullSafe(F.col("p.burst_id")), F.col("p.us"))
    foreign = carried(marked, starts, "us", "photo_id", "foreign_us", True)
    w = Window.partitionBy("burst_id").orderBy("us", "photo_id")
    linked = foreign.where("burst_id IS NOT NULL").withColumns({"a": F.lag("photo_id").over(w), "a_us": F.lag("us").over(w)})
    unbroken = F.col("foreign_us").isNull() | (F.col("foreign_us") <= F.col("a_us")) | (gap_s(F.col("a_us"), F.col("foreign_us")) <= delta_s)
    return linked.where(F.col("a").isNotNull() & unbroken).select("a", F.col("photo_id").alias("b"))


def grouped(photos: DataFrame, edges: DataFrame) -> DataFrame:
    """(photo_id, group_id, representative): every photo with its group, named by the least id in it.
    The representative is the earliest photo; those without edges, untimed ones among them, are alone."""
    parts = connected_components(edges, "a", "b").withColumnsRenamed({"node": "photo_id", "component": "group_id"})
    labelled = photos.select("photo_id", "us").join(parts, "photo_id", "left").withColumn("group_id", F.coalesce("group_id", "photo_id"))
    first = F.min_by("photo_id", F.struct("us", "photo_id")).over(Window.partitionBy("group_id"))
    return labelled.withColumn("representative", first).select("photo_id", "group_id", "representative")


def bursts(photos: DataFrame, features: DataFrame, config: CullConfig = CullConfig(), similarity: float | None = None) -> DataFrame:
    """Bursts of all photos; a null burst_id forces nothing."""
    delta = adaptive_gap(photos, config).first()["delta_s"]
    edges = similar_edges(photos, features, delta, config.burst_similarity if similarity is None else similarity, config.hash_distance)
    return grouped(photos, edges.unionByName(forced_edges(photos, delta)))


def thresholds(faces: DataFrame, config: CullConfig = CullConfig()) -> DataFrame:
    """One row: share of photos with a face of portrait size, the shift it gives, and both thresholds.

    ``faces`` has a row for each photo with features and its ``faces`` array. Without photos nothing shifts.
    """
    share = F.avg(F.coalesce(F.exists("faces", lambda f: f["area"] >= PORTRAIT_AREA), F.lit(False)).cast("int"))
    shift = bias(F.col("share")) if config.adaptive_thresholds else F.lit(0.0)
    moved = lambda t: shifted(t, F.col("bias")) if config.adaptive_thresholds else F.lit(t)
    out = faces.agg(share.alias("share")).withColumn("bias", F.coalesce(shift, F.lit(0.0)))
    return out.withColumns({"burst_similarity": moved(config.burst_similarity), "composition_similarity": moved(config.composition_similarity)})
