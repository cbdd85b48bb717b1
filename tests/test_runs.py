"""Whole runs against a plain walk through the same steps."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from burstframe import pipeline
from burstframe.config import CullConfig
from burstframe.operators import cache, plan, report, select
from burstframe.operators.compositions import peel
from burstframe.pipeline import cull
from burstframe.sources import photos, pictures

FACE = "array<struct<area:double,eye_open:double,smile:double,sharpness:double>>"
FEATURE = f"photo_id bigint, embedding array<double>, phash bigint, exposure double, wb double, sharpness_raw double, noise double, aesthetic double, composition double, faces {FACE}"


def made(spark, seed, n=40):
    r = random.Random(seed)
    photos_, features = [], []
    for i in range(n):
        a = r.choice((0.0, 0.1, 0.9, 1.0, 2.0)) + r.random() * 0.15
        photos_.append((i, None if i == 3 else (i // 5) * 60_000_000 + i % 5 * 100_000, None))
        if i != 7:
            one = [r.random() if r.random() > 0.05 else None for _ in range(6)]
            features.append((i, [math.cos(a), math.sin(a)] if i % 13 else None, r.choice((0, 3, 2**20 - 1)), *one, [(0.01, None, None, None)] if i % 3 == 0 else None))
    return photos_, features, spark.createDataFrame(photos_, "photo_id bigint, us bigint, burst_id string"), spark.createDataFrame(features, FEATURE)


def components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_run_against_a_walk(spark, seed):
    rows, features, p, f = made(spark, seed)
    run = cull(p, f, CullConfig())
    by = {x[0]: x for x in features}
    dot = lambda a, b: sum(x * y for x, y in zip(by[a][1], by[b][1]))
    edges = []
    for a, ua, _ in rows:
        for b, ub, _ in rows:
            if a < b and ua is not None and ub is not None and ub - ua <= 300_000 and a in by and b in by:
                alike = dot(a, b) > 0.925 if by[a][1] and by[b][1] else bin(by[a][2] ^ by[b][2]).count("1") <= 6
                edges += [(a, b)] * alike
    want = components([x[0] for x in rows], edges)
    assert {r["photo_id"]: r["group_id"] for r in run.groups.collect()} == want
    kept = {r["photo_id"] for r in run.burst_picks.where("verdict = 'kept'").collect()}
    assert all(sum(want[k] == g for k in kept) <= 3 for g in set(want.values()))
    pool = sorted(k for k in kept if by[k][1])
    parts = components(pool, [(a, b) for a in pool for b in pool if a < b and dot(a, b) > 0.905])
    final = {}
    for g in set(parts.values()):
        inside = [k for k in pool if parts[k] == g]
        out = peel(np.array([by[k][1] for k in inside]), 0.905 - 0.05)
        stay = [k for k, o in zip(inside, out) if not o]
        final |= {k: k if o else min(stay) for k, o in zip(inside, out)}
    assert {r["photo_id"]: r["composition_id"] for r in run.composition_picks.collect()} == final
    plan = {r["photo_id"]: r["verdict"] for r in run.plan.collect()}
    picked = {r["photo_id"] for r in run.composition_picks.where("verdict = 'kept'").collect()}
    assert plan == {x[0]: "picked" if x[0] in picked else "rejected" for x in rows}
    c = run.counters().first()
    assert (c["photo_count"], c["picked_count"], c["rejected_count"]) == (len(rows), len(picked), len(rows) - len(picked))
    assert run.reports().count() == c["burst_count"]


def test_run_without_embeddings_falls_back_to_bursts(spark):
    rows, features, p, f = made(spark, 5, 12)
    run = cull(p, f, CullConfig(embeddings=False, k1=1))
    assert run.composition_picks is None
    unscored = {r["group_id"] for r in run.groups.collect()} - {r["group_id"] for r in run.burst_picks.collect()}
    kept = {r["photo_id"] for r in run.burst_picks.where("verdict = 'kept'").collect()} | {r["photo_id"] for r in run.groups.collect() if r["group_id"] in unscored}
    assert {r["photo_id"] for r in run.plan.where("verdict = 'picked'").collect()} == kept
    assert cull(p.where("false"), f.where("false")).plan.count() == 0


def test_cache_is_stored_by_generation(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert cache.load(spark, path) is None
    one = spark.createDataFrame([("a", 4, 1)], "content_key string, schema_version int, created_at bigint")
    cache.store(one, path)
    fresh = spark.createDataFrame([("a", 2), ("b", 2)], "content_key string, created_at bigint")
    cache.store(cache.upserted(cache.load(spark, path), fresh), path)
    assert sorted(map(tuple, cache.load(spark, path).collect())) == [("a", 4, 2), ("b", 4, 2)]


def test_pictures_are_decoded_and_unreadable_ones_left_out(spark, tmp_path):
    import struct
    import zlib

    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[0, 0], rgb[1, 2] = (255, 0, 0), (0, 0, 255)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in rgb))) + chunk(b"IEND", b"")
    (tmp_path / "a.jpg").write_bytes(png)
    (tmp_path / "b.jpg").write_bytes(b"broken")
    found = photos.scan_directory(spark, str(tmp_path))
    got = pictures.decoded(spark, found, str(tmp_path)).collect()
    assert len(got) == 1 and (got[0]["width"], got[0]["height"], bytes(got[0]["rgb"])) == (3, 2, rgb.tobytes())


def _jpeg(spark, path, shade, size=96):
    """A JPEG of stripes, by the JVM's writer."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(size, size, 1)
    for x in range(size):
        for y in range(0, size, 1):
            image.setRGB(x, y, int(shade + (x // 8 % 2) * 0x303030))
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    return path.read_bytes()


def test_files_to_plan_and_again_from_the_cache(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = [_jpeg(spark, folder / f"{i}.jpg", 0x202020 * (1 + i % 3), 32) for i in range(4)]
    (folder / "raw.nef").write_bytes(b"II*\0" + b"\0" * 60 + data[0] + b"\0" * 40)
    (folder / "empty.CR2").write_bytes(b"II*\0" + b"\0" * 60)
    (folder / "broken.jpg").write_bytes(b"no picture")
    (folder / "note.txt").write_text("x")

    def embed(rgb):
        return [float(rgb.mean() / 255), 1.0]

    def detect(rgb, grey):
        return [{"x": 0.1, "y": 0.1, "w": 0.5, "h": 0.4, "eye_open_prob": 0.9, "smile_prob": None, "local_sharpness": 3.0}]

    def run(**more):
        return pipeline.cull_files(spark, str(folder), cache_path=f"file://{tmp_path}/cache", embed=embed, detect=detect, preview_folder=str(tmp_path / "previews"), **more)

    first = run()
    assert (first.cached_count, first.extracted_count, first.photos.count()) == (0, 5, 7)
    plan_ = {r["photo_id"]: r["verdict"] for r in first.cull.plan.collect()}
    assert len(plan_) == 7 and "picked" in plan_.values()
    assert first.cull.composition_picks is not None and first.cull.composition_reports().count() >= 1
    face = cache.load(spark, f"file://{tmp_path}/cache").first()["faces"][0]
    assert abs(face["area"] - 0.2) < 1e-6 and abs(face["eye_open"] - 0.9) < 1e-6 and face["smile"] is None
    again = run()
    # Two files can't be decoded, so they miss each time. Equal contents are one row of the cache.
    assert (again.cached_count, again.extracted_count) == (5, 0)
    assert {r["photo_id"]: r["verdict"] for r in again.cull.plan.collect()} == plan_
    page = again.page()
    assert "cached_count: 5" in page and page.count("<h2>") == again.cull.reports().count() + again.cull.composition_reports().count()
    listed = pipeline.cull_files(spark, files=[str(folder / "0.jpg"), str(folder / "raw.nef"), str(folder / "gone.jpg")], preview_folder=str(tmp_path / "p2"))
    assert (listed.cached_count, listed.extracted_count, listed.photos.count()) == (0, 2, 2)
    with pytest.raises(ValueError):
        run(config=CullConfig(k1=0))


def test_pages_hold_all_groups(spark, tmp_path):
    reports = report.nested(spark.range(12_000).selectExpr("id AS group_id", "id AS photo_id"), spark.createDataFrame([(1, 1, 1, "kept", 0.5)], "group_id bigint, photo_id bigint, rank int, verdict string, value double"))
    assert report.page(reports).count("<h2>") == 12_000
    report.write_page(reports, f"file://{tmp_path}/page")
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/page").collect()]
    assert len(lines) == 12_000 and "<h2>1</h2><ol><li class=kept>1 kept #1 0.500</ol>" in lines


def test_small_pieces(spark, tmp_path):
    faces = spark.createDataFrame([("[{\"area\": 0.5, \"smile\": 0.1}]",), ("{broken",), (None,), ("[oops",)], "j string")
    got = [r["f"] for r in faces.select(cache.faces_of(F.col("j")).alias("f")).collect()]
    assert got[0][0]["area"] == 0.5 and got[0][0]["eye_open"] is None and got[1:] == [None, None, None]
    back = faces.limit(1).select(cache.faces_of(cache.faces_json(cache.faces_of(F.col("j")))).alias("f")).first()["f"]
    assert back == got[0]
    photos_ = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "photo_id bigint, path string")
    p = spark.createDataFrame([(1, "picked"), (2, "rejected"), (3, "rejected")], "photo_id bigint, verdict string")
    assert [tuple(r) for r in plan.deletions(p, photos_).collect()] == [(2, "b")] and cache.row_count(photos_) == 3
    scores_ = spark.createDataFrame([(1, 1, 0, 0.9, 0.1), (1, 2, 0, 0.2, 0.8)], "group_id bigint, photo_id bigint, us bigint, value double, tech double")
    assert [r["photo_id"] for r in select.top_technical(scores_, 1).where("verdict = 'kept'").collect()] == [2]
    images = spark.createDataFrame([(7, 4, 2, bytes(24))], "photo_id bigint, width int, height int, rgb binary")
    place = pictures.stored_thumbnail(images, str(tmp_path / "t"), 2).first()["thumbnail"]
    assert open(place, "rb").read() == b"P6 2 1 255\n" + bytes(6)
