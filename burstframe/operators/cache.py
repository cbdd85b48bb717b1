"""A cache of features by content: lookup, what is missing, and replacement of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 4


def probed(photos: DataFrame, cache: DataFrame, embeddings: bool = True, faces: bool = True, version: int = VERSION) -> DataFrame:
    """``photos`` with the cached features of their content_key (null if there are none of this version) and ``miss``:
    no row, or a wanted embedding or faces missing. A null key misses."""
    current = cache.where(F.col("schema_version") == version).drop("schema_version")
    names = [c for c in current.columns if c != "content_key"]
    right = current.select(F.col("content_key").alias("__key"), *(F.col(c).alias(f"c_{c}") for c in names))
    miss: Column = F.col("__key").isNull()
    for wanted, name in ((embeddings, "embedding"), (faces, "faces")):
        if wanted and name in names:
            miss = miss | F.col(f"c_{name}").isNull()
    return photos.join(right, photos["content_key"] == right["__key"], "left").withColumn("miss", miss).drop("__key")


def composed_by_cache(probe: DataFrame, model_loaded: bool, embeddings: bool = True) -> bool:
    """Whether compositions are made. If nothing misses, it is so if any cached row has an embedding, wanted or not;
    else if the model is loaded."""
    row = probe.agg(F.max("miss").alias("miss"), F.max(F.col("c_embedding").isNotNull()).alias("some")).first()
    return bool(row["some"]) if row["miss"] is False else model_loaded and embeddings


def upserted(cache: DataFrame, fresh: DataFrame, version: int = VERSION) -> DataFrame:
    """The cache with ``fresh`` rows in place of those of their key, whatever their version. Of several fresh rows of one key the latest by created_at counts."""
    names = [c for c in cache.columns if c not in ("content_key", "schema_version")]
    w = Window.partitionBy("content_key").orderBy(F.col("created_at").desc(), F.xxhash64(*names))
    new = fresh.where("content_key IS NOT NULL").withColumn("schema_version", F.lit(version)).withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*cache.columns)
    keys = new.select(F.col("content_key").alias("__key"))
    return cache.join(keys, cache["content_key"] == keys["__key"], "left_anti").unionByName(new)


def deduplicated(rows: DataFrame, key: str = "content_key", by: str = "photo_id") -> DataFrame:
    """(key, copies, first): distinct contents."""
    return rows.groupBy(key).agg(F.count("*").alias("copies"), F.min(by).alias(f"first_{by}"))


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished generations below ``path``, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("g=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache as it was last stored; None if it never was."""
    done = _generations(spark, path)
    return spark.read.parquet(f"{path}/g={done[-1]}") if done else None


def store(cache: DataFrame, path: str) -> None:
    """Write the whole cache as a new generation; readers see the old one until the new one is complete."""
    done = _generations(cache.sparkSession, path)
    cache.write.mode("overwrite").parquet(f"{path}/g={done[-1] + 1 if done else 0}")
    # Readers may still be at the last one; older ones go.
    jvm = cache.sparkSession.sparkContext._jvm
    for g in done[:-1]:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/g={g}")
        folder.getFileSystem(cache.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


FACES = "array<struct<area:double,eye_open:double,smile:double,sharpness:double>>"


def faces_json(faces: Column) -> Column:
    """Faces as text for stores without structures; null stays null."""
    return F.to_json(faces)


def faces_of(text: Column) -> Column:
    """Faces of such text; null if it is no JSON array."""
    return F.from_json(F.when(F.trim(text).startswith("["), text), FACES)


def row_count(cache: DataFrame) -> int:
    """Rows of any version."""
    return cache.count()
