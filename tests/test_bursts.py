import random

import pytest

from burstframe.config import CullConfig
from burstframe.functions.vectors import hamming  # noqa: F401
from burstframe.operators import bursts, compositions
from burstframe.operators.components import connected_components
from burstframe.operators.timeline import carried

PHOTO = "photo_id bigint, us bigint, burst_id string"
FEATURE = "photo_id bigint, embedding array<double>, phash bigint"


def made(spark, photos, features):
    return spark.createDataFrame(photos, PHOTO), spark.createDataFrame(features, FEATURE)


def grouped(spark, photos, features, **knobs):
    out = bursts.bursts(*made(spark, photos, features), CullConfig(**knobs)).collect()
    by = {}
    for r in out:
        by.setdefault(r["group_id"], set()).add(r["photo_id"])
    return sorted(map(sorted, by.values()))


def ms(*times):
    return [(i, None if t is None else t * 1000, None) for i, t in enumerate(times)]


def same_hash(n):
    return [(i, None, 12345) for i in range(n)]


def test_five_close_frames_are_one_burst(spark):
    assert grouped(spark, ms(0, 100, 200, 300, 400), same_hash(5)) == [[0, 1, 2, 3, 4]]


def test_a_minute_apart_is_two_bursts(spark):
    assert grouped(spark, ms(0, 60_000), same_hash(2)) == [[0], [1]]


def test_an_odd_frame_in_the_middle_stays_out(spark):
    assert grouped(spark, ms(0, 100, 200), [(0, None, 0), (1, None, 255), (2, None, 0)]) == [[0, 2], [1]]


def test_opposite_hashes_stay_apart(spark):
    assert grouped(spark, ms(0, 100), [(0, None, 0), (1, None, -1)]) == [[0], [1]]


def test_embeddings_decide_before_hashes_and_only_at_one_length(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.0, 0.0]
    assert grouped(spark, ms(0, 100), [(0, a, 7), (1, b, 7)]) == [[0], [1]]
    assert grouped(spark, ms(0, 100), [(0, a, 0), (1, a, -1)]) == [[0, 1]]
    assert grouped(spark, ms(0, 100), [(0, a, 7), (1, c, 7)]) == [[0, 1]]
    assert grouped(spark, ms(0, 100), [(0, a, 7), (1, None, 7)]) == [[0, 1]]
    assert grouped(spark, ms(0, 100), [(0, a, 7)]) == [[0], [1]]


def test_similarity_must_exceed_the_threshold(spark):
    x = [0.6, 0.8]
    assert grouped(spark, ms(0, 100), [(0, [1.0, 0.0], 0), (1, x, 0)], burst_similarity=0.6) == [[0], [1]]


def test_burst_id_joins_beyond_the_window_unless_another_frame_breaks_it(spark):
    far = [(0, 0, "x"), (1, 100_000_000, "x")]
    features = [(i, None, k) for i, k in enumerate((0, -1, 255))]
    assert grouped(spark, far, features) == [[0, 1]]
    assert grouped(spark, [*far, (2, 90_000_000, None)], features) == [[0], [1], [2]]
    assert grouped(spark, [*far, (2, 1_000, None)], features) == [[0, 1], [2]]


def test_untimed_photos_are_alone_whatever_their_burst_id(spark):
    assert grouped(spark, [(0, None, "x"), (1, None, "x"), (2, 0, None)], same_hash(3)) == [[0], [1], [2]]


def test_no_photos(spark):
    assert grouped(spark, [], []) == []


def test_gap_is_bounded_and_defaults_to_two_seconds(spark):
    delta = lambda *t: bursts.adaptive_gap(spark.createDataFrame(ms(*t), PHOTO)).first()[0]
    assert delta(5) == 6.0
    assert delta(0, 1) == 0.3
    assert delta(0, 1000, 3000) == pytest.approx(4.5)
    assert delta(0, 3_600_000, 7_300_000) == 30.0


def brute(photos, features, config):
    """The pairwise scan in order of time, and union-find."""
    timed = sorted((p for p in photos if p[1] is not None), key=lambda p: (p[1], p[0]))
    f = {r[0]: r for r in features}
    gaps = sorted((b[1] - a[1]) // 1000 / 1000 for a, b in zip(timed, timed[1:]))
    n = len(gaps)
    median = 2.0 if not n else gaps[n // 2] if n % 2 else (gaps[n // 2 - 1] + gaps[n // 2]) / 2
    delta = min(max(config.time_k * median, config.min_dt), config.max_dt)
    root = {p[0]: p[0] for p in photos}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(timed):
        for b in timed[i + 1 :]:
            if a[2] is not None and a[2] == b[2]:
                root[find(b[0])] = find(a[0])
                continue
            if (b[1] - a[1]) // 1000 / 1000 > delta:
                break
            if a[0] in f and b[0] in f and bin((f[a[0]][2] ^ f[b[0]][2]) & (2**64 - 1)).count("1") <= config.hash_distance:
                root[find(b[0])] = find(a[0])
    by = {}
    for p in photos:
        by.setdefault(find(p[0]), []).append(p[0])
    return sorted(sorted(v) for v in by.values())


@pytest.mark.parametrize("seed", range(4))
def test_against_the_scan(spark, seed):
    r = random.Random(seed)
    photos = [(i, None if r.random() < 0.1 else r.randrange(200) * 700_000 + r.choice((0, 1_800_000_000)), r.choice((None, None, "a", "b", "c"))) for i in range(60)]
    features = [(i, None, r.choice((0, 15, 255, 2**40 - 1))) for i in range(60) if r.random() < 0.9]
    assert grouped(spark, photos, features, max_dt=2.0) == brute(photos, features, CullConfig(max_dt=2.0))


def test_carried_values_cross_buckets(spark):
    r = random.Random(1)
    data = [(i, r.randrange(1000), r.choice((None, r.randrange(9)))) for i in range(200)] + [(900, None, 3)]
    got = {x["id"]: x["last"] for x in carried(spark.createDataFrame(data, "id int, us bigint, v int"), __import__("pyspark.sql.functions", fromlist=["col"]).col("v"), "us", "id", "last", True, 10).collect()}
    last, want = None, {900: None}
    for i, _, v in sorted((d for d in data if d[1] is not None), key=lambda d: (d[1], d[0])):
        last = v if v is not None else last
        want[i] = last
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_thresholds_follow_the_share_of_portraits(spark):
    def at(*areas):
        f = spark.createDataFrame([(None if a is None else [(a,)],) for a in areas], "faces array<struct<area:double>>")
        return [round(x, 6) for x in bursts.thresholds(f).first()]

    assert at(None, None) == [0.0, -0.025, 0.925, 0.905]
    assert at(0.1, None) == [0.5, 0.0, 0.95, 0.93]
    assert at(0.1, 0.05) == [1.0, 0.025, 0.975, 0.955]


def parts(spark, vectors, **knobs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "photo_id bigint, embedding array<double>")
    by = {}
    for r in compositions.compositions(df, CullConfig(**knobs)).collect():
        by.setdefault(r["composition_id"], set()).add(r["photo_id"])
    assert all(min(v) == k for k, v in by.items())
    return sorted(map(sorted, by.values()))


def planar(*degrees):
    from math import cos, radians, sin

    return [[cos(radians(d)), sin(radians(d))] for d in degrees]


def test_compositions_split_and_merge(spark):
    assert parts(spark, planar(0, 0)) == [[0, 1]]
    assert parts(spark, planar(0, 90)) == [[0], [1]]
    assert parts(spark, planar(0, 40)) == [[0], [1]]
    assert parts(spark, [None, [1.0, 0.0], []]) == [[1]]


def test_the_end_of_a_chain_is_peeled_off(spark):
    assert parts(spark, planar(0, 20, 40, 61)) == [[0, 1, 2], [3]]


def test_blocks_find_every_pair(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(90, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "photo_id bigint, embedding array<double>")
    got = {(r["a"], r["b"]) for r in compositions.similar_pairs(df, 0.5, block=20).collect()}
    s = v @ v.T
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] > 0.5}
