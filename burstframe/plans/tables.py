"""The driver's tables as the engine's: what stands for photos, features, faces, groups and caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import drawn
from ..session import spread, table

WIDTH, HEIGHT = 72, 64
#: Pictures that a task draws and looks at.
PICTURES = 1000


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as photos; some share a burst_id."""
    at = F.expr("unix_micros(CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP))")
    burst = F.when(F.col("event_id") % 7 < 5, F.concat(F.lit("b"), F.expr("event_id div 3").cast("string")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("photo_id"), at.alias("us"), burst.alias("burst_id"))


def plain(photos_: DataFrame) -> DataFrame:
    """Photos whose cameras write no burst_id."""
    return photos_.withColumn("burst_id", F.lit(None).cast("string"))


def _mixed(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """An embedding for each photo_id: four successive ones near one vector, each drawn towards another."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    keyed = ids.select("photo_id", F.expr(f"(photo_id div 4) % {n}").alias("near"), ((F.col("photo_id") * 7 + 3) % n).alias("far"))
    a, b = e.select(F.col("vec_id").alias("near"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("far"), F.col("embedding").alias("y"))
    return keyed.join(a, "near").join(b, "far").select("photo_id", drawn(F.col("x"), F.col("y"), 0.1 * (F.col("photo_id") % 5)).alias("embedding"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("photo_id"))
    return _mixed(spark, sf_dir, ids).withColumn("phash", phash())


def phash():
    return F.expr("((((photo_id div 4) % 2147483648) * 2654435761) % 4294967296) ^ (shiftleft(1L, cast(photo_id % 5 * 3 as int)) - 1)")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with made-up scores; every eleventh photo has none."""
    k = F.col("photo_id")
    share = lambda m: k * m % 100 / 100.0
    faces_ = F.when(k % 4 == 0, F.array(F.struct((k % 10 / 100.0).alias("area"), share(9).alias("eye_open"), share(17).alias("smile"), share(23).alias("sharpness"))))
    return features(spark, sf_dir).select("*", F.when(k % 11 != 0, share(1)).alias("exposure"), share(7).alias("wb"), share(31).alias("sharpness_raw"), share(13).alias("noise"), share(3).alias("aesthetic"), share(19).alias("composition"), faces_.alias("faces"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("photo_id"))
    return ids.select("photo_id", F.lit(None).cast("array<double>").alias("embedding"), phash().alias("phash"))


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of photos that bursts kept: one for each row of ``embeddings``."""
    return _mixed(spark, sf_dir, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id")))


def _faces_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, faces): ``lineitem`` as faces, by number."""
    face = F.struct(F.col("l_discount").alias("area"), (F.col("l_tax") * 12).alias("eye_open"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 8).alias("smile"), F.col("l_quantity").alias("sharpness"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", face.alias("f")))), lambda x: x["f"]).alias("faces"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, faces) of each photo in ``orders``; one without lines has none."""
    o, per = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("photo_id")), _faces_of(spark, sf_dir)
    return o.join(per, o["photo_id"] == per["l_orderkey"], "left").select("photo_id", "faces")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as photos, a customer's as a burst, three customers' as a composition; some lack a signal."""
    k = F.col("o_orderkey")
    share = lambda m: k * m % 100 / 100.0
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_id"), (F.col("o_custkey") - F.col("o_custkey") % 3).alias("composition_id"), k.alias("photo_id"),
        F.expr("unix_micros(CAST(convert_timezone('UTC', current_timezone(), CAST(o_orderdate AS TIMESTAMP_NTZ)) AS TIMESTAMP))").alias("us"),
        F.when(k % 17 != 0, share(1)).alias("exposure"), share(7).alias("wb"), (F.col("o_totalprice") / 1000).alias("sharpness_raw"), share(13).alias("noise"),
        F.when(k % 5 != 0, share(3)).alias("aesthetic"), F.when(k % 6 != 0, share(11)).alias("composition"),
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.when(k % 2 == 0, ".jpg").otherwise(".NEF")).alias("path"),
    )
    per = _faces_of(spark, sf_dir)
    return o.join(per, o["photo_id"] == per["l_orderkey"], "left").drop("l_orderkey")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn picture for each row of ``supplier``: busy, soft with a coloured patch, or plain grey."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:HEIGHT, :WIDTH]
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                p = np.full((HEIGHT, WIDTH, 3), 128, np.int64)
                if i % 3 == 0:
                    p = np.stack([(x * 7 + y * 13 + i * 31) % 256, (x * 3 + y * 5 + i * 17) % 256, (x * 11 + y * 2 + i * 7) % 256], axis=2)
                elif i % 3 == 1:
                    p[20:45, 20 + i % 9 : 50] = (160, 112, 128)
                out.append(p.astype(np.uint8).tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([WIDTH] * n, pa.int32()), pa.array([HEIGHT] * n, pa.int32()), pa.array(out, pa.binary()), pa.array([float(i % 4) for i in b.column(0).to_pylist()]), pa.array([100 * (i % 5) for i in b.column(0).to_pylist()], pa.int32())], names=["photo_id", "width", "height", "rgb", "ev", "iso"])

    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("photo_id"))
    return spread(ids, "photo_id", PICTURES).mapInArrow(draw, "photo_id bigint, width int, height int, rgb binary, ev double, iso int")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*(F.lit(e) for e in (".jpg", ".JPEG", ".nef", ".CR3", ".txt", "", ".jpe", ".tiff", ".Dng", ".heic", ".RAF", ".jpg.bak")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 12 + 1).cast("int"))).alias("path"))


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature cache that holds the contents of English documents, some of an older version, some incomplete."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.substring(F.sha2("text", 256), 1, 32).alias("content_key"), "doc_id").groupBy("content_key").agg(F.min("doc_id").alias("k"))
    return d.where("content_key IS NOT NULL").select("content_key", F.when(F.col("k") % 3 == 0, 3).otherwise(4).alias("schema_version"), F.when(F.col("k") % 5 != 0, F.array(F.lit(1.0))).alias("embedding"), F.when(F.col("k") % 7 != 0, F.array(F.lit(1.0))).alias("faces"), F.col("k").alias("created_at"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), F.substring(F.sha2("text", 256), 1, 32).alias("content_key"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "stage").when(F.col("event_id") % 4 == 3, "finish").otherwise("tick")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("stage"), F.col("value").alias("done"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up model's answer for each turn of ``conversations``."""
    s = lambda c: c.cast("string")
    t, k = F.col("turn"), F.col("conv_id") % 5 + 1
    line = F.concat(F.lit("**Rank "), s(t + 1), F.lit(" (Image "), s(k), F.lit(")**: "), F.col("role"), F.lit(" first\nImage #"), s(k + 1), F.lit(" - Rank "), s(t + 2), F.lit(": *"), F.col("role"), F.lit("*\nRank 9 (Image "), s(k), F.lit("): again\n排名 "), s(t + 3), F.lit(" (Image "), s(k + 2), F.lit("): **"), F.col("role"), F.lit("**\nImage "), s(k + 3), F.lit(" (第 "), s(t + 4), F.lit("): last"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("answer"))
