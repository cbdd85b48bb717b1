"""What keeps queries in proportion to their input."""

import numpy as np
import pytest

from burstframe.operators import compositions

VECTOR = "photo_id bigint, embedding array<double>"


def near_some(seed, groups=12, each=9, width=6):
    """Vectors about middles, some farther off than others, with copies."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, width))
    v = np.repeat(middles, each, axis=0) + r.normal(size=(groups * each, width)) * r.choice([0.0, 0.2, 0.5], size=(groups * each, 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.concatenate([v, v[::5], np.zeros((2, width))])


def brute(v, t, limit):
    s = v @ v.T > t
    name = np.arange(len(v))
    while True:
        new = np.where(s, name[None, :], len(v)).min(axis=1)
        new = np.minimum(new, name)
        if (new == name).all():
            break
        name = new
    out = {}
    for c in np.unique(name):
        ids = np.flatnonzero(name == c)
        leaves = compositions.peel(v[ids], limit)
        out |= {int(i): int(i) if gone else int(ids[~leaves].min()) for i, gone in zip(ids, leaves)}
    return out


@pytest.mark.parametrize("seed, sent, listed", [(0, 1 << 15, 64), (1, 20, 64), (2, 20, 0)])
def test_compositions_without_all_pairs(spark, monkeypatch, seed, sent, listed):
    monkeypatch.setattr(compositions, "similar_pairs", None)
    monkeypatch.setattr(compositions, "SENT", sent)
    monkeypatch.setattr(compositions, "LISTED", listed)
    v = near_some(seed)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTOR)
    got = {r["photo_id"]: r["composition_id"] for r in compositions.compositions(df, similarity=0.93).collect()}
    assert got == brute(v, 0.93, 0.88)


def test_vectors_longer_than_one_are_compared_all(spark):
    v = [[2.0, 0.0], [0.7, 0.1], [0.0, 0.6], [float("nan"), 1.0], [0.7, 0.1]]
    df = spark.createDataFrame(list(enumerate(v)), VECTOR)
    got = {r["photo_id"]: r["composition_id"] for r in compositions.compositions(df, similarity=0.93).collect()}
    assert got == brute(np.array(v), 0.93, 0.88)


def test_export_names_of_many_families_in_one_call(spark, monkeypatch):
    """Families are named a task at a time, and as if each name given were looked up."""
    import random

    from pyspark.sql.group import GroupedData

    from burstframe.functions.strings import unused_name
    from burstframe.operators import sinks

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    r = random.Random(3)
    names = [r.choice(("a", "b", "", ".x", "a.b")) + r.choice(("", " (2)", " (3)", " (02)", " (2) (2)", " (10)")) + r.choice((".jpg", ".", "", ".jpg (2)")) for _ in range(400)]
    taken = ["a.jpg", "a (3).jpg", "b"]
    got = {x["photo_id"]: x["exported"] for x in sinks.export_names(spark.createDataFrame(list(enumerate(names)), "photo_id bigint, name string"), taken).collect()}
    used = set(taken)
    want = {i: unused_name(n, used) for i, n in enumerate(names)}
    assert got == want and len(set(got.values())) == len(names)


@pytest.mark.parametrize("name", ["exposure_px", "wb_px", "sharpness_px", "noise_px", "aesthetic_px", "composition_px"])
def test_pictures_are_dealt_to_tasks_and_one_score_is_worked_out(spark, data, name):
    from burstframe.operators import features
    from burstframe.plans import catalogue, tables

    got = catalogue.queries()[name](spark, f"{data}/sf0.01")
    assert got.rdd.getNumPartitions() == 4
    column = got.columns[1]
    every = features.extracted(tables.images(spark, f"{data}/sf0.01")).collect()
    assert {r[0]: r[1] for r in got.collect()} == {r["photo_id"]: round(r[column], 9) for r in every}


def test_sketches_and_vectors_give_the_same_edges(spark):
    """Cosines on both sides of the threshold, closer to it than sketches can tell, and vectors that have no sketch."""
    from burstframe.operators import bursts

    angles = np.arccos(0.95) + np.array([-1e-3, -1e-5, -1e-7, 1e-7, 1e-5, 1e-3])
    v = [[1.0, 0.0], *([float(np.cos(x)), float(np.sin(x))] for x in angles), [3.0, 0.1], [0.97, 0.0], None, [1.0], [float("nan"), 0.0]]
    photos = spark.createDataFrame([(i, i * 1000, None) for i in range(len(v))], "photo_id bigint, us bigint, burst_id string")
    features = spark.createDataFrame([(i, x, 0 if i > 8 else -1) for i, x in enumerate(v)], "photo_id bigint, embedding array<double>, phash bigint")
    got = {(r["a"], r["b"]) for r in bursts.similar_edges(photos, features, 1.0, 0.95, 6).collect()}
    want = set()
    for b in range(len(v)):
        for a in range(b):
            if v[a] is not None and v[b] is not None and len(v[a]) == len(v[b]):
                if sum(p * q for p, q in zip(v[a], v[b])) > 0.95 or 11 in (a, b):  # Spark's NaN is above all
                    want.add((a, b))
            elif a > 8 and b > 8:
                want.add((a, b))
    assert got == want


def test_pairs_of_photos_carry_no_whole_vectors(spark, data):
    """The joins of pairs read sketches only."""
    from burstframe.operators import bursts

    n, r = 4000, np.random.default_rng(0)
    v = r.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    photos = spark.createDataFrame([(i, i * 500_000, None) for i in range(n)], "photo_id bigint, us bigint, burst_id string")
    seen = []
    real = bursts.cut
    bursts.cut = lambda df: seen.append(df) or real(df)
    try:
        bursts.similar_edges(photos, spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "photo_id bigint, embedding array<double>, phash bigint"), 1.0, 0.95, 6)
    finally:
        bursts.cut = real
    # What the upper join puts out: ids, sketches, widths and hashes.
    join = seen[0]._jdf.queryExecution().optimizedPlan()
    while "Join" not in join.nodeName():
        join = join.children().head()
    assert "a_sketch" in join.output().toString() and "embedding" not in join.output().toString() and "_vec" not in join.output().toString()


def test_largest_face_is_worked_out_once(spark, data):
    from burstframe.operators import select
    from burstframe.plans import tables

    plan = select.scored(tables.members(spark, f"{data}/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1


def test_pivots_are_picked_without_moving_vectors(spark, monkeypatch):
    """The first batch of pivots reaches the vectors as a broadcast."""
    seen, kind = [], type(spark.range(1))
    real = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(compositions, "SENT", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(near_some(5))], VECTOR)
        compositions.compositions(df, similarity=0.93)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]
