"""Pictures of photo files: decoded, turned upright and made smaller."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import oriented, thumbnail
from .photos import preview


def decoded(spark: SparkSession, photos: DataFrame, root: str | list[str], longest: int = 1024) -> DataFrame:
    """(photo_id, width, height, rgb, ev, iso) of the photos (as ``scan_directory`` gives them) below ``root``
    whose files can be decoded; others give no row. At most ``longest`` pixels a side."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    wanted = photos.select("photo_id", plain(F.col("path")).alias("p"), "orientation", F.col("exposure_bias_ev").cast("double").alias("ev"), "iso")
    rows = found.join(wanted, plain(F.col("origin")) == F.col("p")).select("photo_id", "orientation", "ev", "iso", "width", "height", "nChannels", "data")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                # Stored blue first; grey has one channel, and transparency a fourth.
                a = np.repeat(a, 3, axis=2) if r["nChannels"] == 1 else a[:, :, 2::-1]
                a = thumbnail(np.ascontiguousarray(oriented(a, r["orientation"] or 1)), longest)
                out.append((a.shape[1], a.shape[0], a.tobytes()))
            w, h, rgb = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([b.column("photo_id"), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgb, pa.binary()), b.column("ev"), b.column("iso")], names=["photo_id", "width", "height", "rgb", "ev", "iso"])

    return rows.mapInArrow(turn, "photo_id bigint, width int, height int, rgb binary, ev double, iso int")


def previews(spark: SparkSession, photos: DataFrame, root: str | list[str], folder: str) -> DataFrame:
    """The raw ``photos`` with ``path`` leading to their embedded pictures, which are written to ``folder``, one that all
    machines share; those without one are left out. A repeated task writes the same files again."""
    os.makedirs(folder, exist_ok=True)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    raw = photos.where("format = 'raw'").withColumn("__p", plain(F.col("path"))).drop("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain(F.col("path")).alias("__at"), "content")
    rows = files.join(raw, F.col("__at") == F.col("__p")).select("photo_id", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for i, content in zip(b.column(0).to_pylist(), b.column(1)):
                if picture := preview(content.as_py()):
                    place, new = f"{folder}/{i}.jpg", f"{folder}/.{i}.{os.getpid()}"
                    with open(new, "wb") as f:
                        f.write(picture)
                    os.replace(new, place)
                    done.append((i, f"file:{os.path.abspath(place)}"))
            ids, paths = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string())], names=["photo_id", "path"])

    made = rows.mapInArrow(write, "photo_id bigint, path string")
    return raw.drop("__p").join(made, "photo_id").select(*photos.columns)


def stored_thumbnail(images: DataFrame, folder: str, edge: int) -> DataFrame:
    """(photo_id, thumbnail): each picture of at most ``edge`` pixels a side as a PPM file in ``folder``, a shared one; a file that is there is kept."""
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = []
            for r in b.to_pylist():
                place = f"{folder}/{r['photo_id']}-{edge}.ppm"
                places.append(place)
                if not os.path.exists(place):
                    a = thumbnail(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3), edge)
                    new = f"{place}.{os.getpid()}"
                    with open(new, "wb") as f:
                        f.write(b"P6 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes())
                    os.replace(new, place)
            yield pa.RecordBatch.from_arrays([b.column("photo_id"), pa.array(places, pa.string())], names=["photo_id", "thumbnail"])

    return images.select("photo_id", "width", "height", "rgb").mapInArrow(write, "photo_id bigint, thumbnail string")
