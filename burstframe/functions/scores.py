"""Column expressions of scene, weights, face bonus and scores.

A face is a struct with area, eye_open, smile and sharpness; all but area may be null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PORTRAIT_AREA, SOFT_AREA = 0.05, 0.02
#: tech, aesthetic, composition, face
SCENE_WEIGHTS = {"portrait": (0.30, 0.20, 0.15, 0.35), "landscape": (0.35, 0.40, 0.25, 0.00), "mixed": (0.32, 0.30, 0.20, 0.18)}
PARTS = ("tech", "aesthetic", "composition", "face")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def face_area(w: Column, h: Column) -> Column:
    return clamp(w * h)


def scene(faces: Column, largest: Column) -> Column:
    return F.when((faces >= 1) & (largest >= PORTRAIT_AREA), "portrait").when(faces == 0, "landscape").otherwise("mixed")


def weight(part: str, faces: Column, largest: Column) -> Column:
    """Weight of one part; between the two areas it goes over from mixed to portrait in a straight line."""
    k = PARTS.index(part)
    portrait, landscape, mixed = (SCENE_WEIGHTS[s][k] for s in ("portrait", "landscape", "mixed"))
    t = (largest - SOFT_AREA) / (PORTRAIT_AREA - SOFT_AREA)
    return F.when(faces == 0, F.lit(landscape)).when(largest >= PORTRAIT_AREA, F.lit(portrait)).when(largest <= SOFT_AREA, F.lit(mixed)).otherwise(mixed + t * (portrait - mixed))


def face_quality(face: Column) -> Column:
    """Weighted mean of the signals that a face has; its size it always has."""
    num, den = 0.3 * clamp(face["area"] / 0.05), F.lit(0.3)
    for name, w in (("sharpness", 0.2), ("eye_open", 0.4), ("smile", 0.1)):
        num = num + F.coalesce(w * clamp(face[name]), F.lit(0.0))
        den = den + F.when(face[name].isNotNull(), w).otherwise(0.0)
    return num / den


def face_bonus(faces: Column) -> Column:
    """Mean quality times coverage; a face surely closed-eyed (below .3) isn't open. Null or no faces: 0."""
    n = F.size(faces)
    opened = F.size(F.filter(faces, lambda f: ~F.coalesce(f["eye_open"] < 0.3, F.lit(False))))
    coverage = F.when(opened >= F.ceil(n * 0.8), F.lit(1.0)).otherwise(opened / n)
    total = F.aggregate(faces, F.lit(0.0), lambda s, f: s + face_quality(f))
    # Through an array of one, since clamp looks at its number twice.
    return F.when(faces.isNotNull() & (n > 0), F.transform(F.array(total / n * coverage), lambda x: clamp(x))[0]).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def standing(x: Column, mean: Column, deviation: Column) -> Column:
    """A value's z-score within its group, squeezed to 0..1."""
    return sigmoid((x - mean) / F.greatest(deviation, F.lit(1e-6)))


def bias(share: Column) -> Column:
    """Shift of both similarity thresholds by the share of portraits."""
    return clamp((share - 0.5) * 0.05, -0.025, 0.025)


def shifted(threshold: float, by: Column) -> Column:
    return clamp(F.lit(threshold) + by, 0.7, 0.99)
