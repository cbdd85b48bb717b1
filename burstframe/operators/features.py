"""Features of photos from their pixels, all kernels in one pass over Arrow batches.

``images`` has photo_id, width, height and rgb (three bytes a pixel, row by row); ev and iso may be there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import pixels

SCORES = ("exposure", "wb", "sharpness_raw", "noise", "aesthetic", "composition")
SCHEMA = "photo_id bigint, phash bigint, dhash bigint, " + ", ".join(f"{s} double" for s in SCORES)
EXTRA = ", embedding array<float>, faces array<struct<x:float,y:float,w:float,h:float,eye_open_prob:float,smile_prob:float,local_sharpness:float>>"


def scores_of(rgb: np.ndarray, ev: float | None = None, iso: int | None = None) -> tuple:
    """phash, dhash and the scores of one picture; the grey image is made once."""
    grey = pixels.luma(rgb)
    return pixels.mean_hash(grey), pixels.gradient_hash(grey), pixels.exposure(grey, ev), pixels.white_balance(rgb), pixels.sharpness(grey), pixels.noise(grey, iso), pixels.aesthetic(rgb), pixels.composition(rgb)


#: Each score from a picture, its grey image, and the exposure correction and sensitivity it was taken with.
KERNELS = {
    "exposure": lambda rgb, grey, ev, iso: pixels.exposure(grey, ev), "wb": lambda rgb, grey, ev, iso: pixels.white_balance(rgb), "sharpness_raw": lambda rgb, grey, ev, iso: pixels.sharpness(grey),
    "noise": lambda rgb, grey, ev, iso: pixels.noise(grey, iso), "aesthetic": lambda rgb, grey, ev, iso: pixels.aesthetic(rgb), "composition": lambda rgb, grey, ev, iso: pixels.composition(rgb),
}


def readable(w: int | None, h: int | None, raw: bytes | None) -> np.ndarray | None:
    """The picture, or None if its bytes aren't its size, or it is empty or null."""
    w, h = w or 0, h or 0
    return None if raw is None or w < 1 or h < 1 or len(raw) != w * h * 3 else np.frombuffer(raw, np.uint8).reshape(h, w, 3)


def score(images: DataFrame, name: str) -> DataFrame:
    """(photo_id, name): one of the SCORES of each picture, as ``extracted`` has it; the other kernels don't run."""
    kernel, columns = KERNELS[name], [n for n in ("photo_id", "width", "height", "rgb", "ev", "iso") if n in images.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for r in batch.to_pylist():
                rgb = readable(r["width"], r["height"], r["rgb"])
                if rgb is not None:
                    ids.append(r["photo_id"])
                    out.append(kernel(rgb, pixels.luma(rgb), r.get("ev"), r.get("iso")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["photo_id", name])

    return images.select(*columns).mapInArrow(work, f"photo_id bigint, {name} double")


def extracted(images: DataFrame, embed: Callable[[np.ndarray], list[float]] | None = None, detect: Callable[[np.ndarray, np.ndarray], list[dict]] | None = None) -> DataFrame:
    """A row of features for each picture. One whose bytes aren't its size, or that is empty or null, gives
    none: the photo stays, without features. ``embed`` and ``detect`` add embedding and faces (null without them)."""
    names = [n for n in ("photo_id", "width", "height", "rgb", "ev", "iso") if n in images.columns]
    plus = embed is not None or detect is not None
    columns = ["photo_id", "phash", "dhash", *SCORES] + ["embedding", "faces"] * plus
    face = pa.struct([(n, pa.float32()) for n in ("x", "y", "w", "h", "eye_open_prob", "smile_prob", "local_sharpness")])
    kinds = [pa.int64()] * 3 + [pa.float64()] * len(SCORES) + [pa.list_(pa.float32()), pa.list_(face)] * plus

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rgb = readable(r["width"], r["height"], r["rgb"])
                if rgb is None:
                    continue
                row = (r["photo_id"], *scores_of(rgb, r.get("ev"), r.get("iso")))
                rows.append(row + ((embed and embed(rgb)), (detect and detect(rgb, pixels.luma(rgb)))) * plus)
            cells = list(zip(*rows)) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds)], names=columns)

    return images.select(*names).mapInArrow(extract, SCHEMA + EXTRA * plus)
