import math
import random

import pytest
from pyspark.sql import functions as F

from burstframe.config import PRESETS, CullConfig, source_of, thumbnail_edge
from burstframe.functions import scores
from burstframe.operators import cache, plan, report, select, sinks

FACE = "array<struct<area:double,eye_open:double,smile:double,sharpness:double>>"
MEMBER = f"group_id bigint, photo_id bigint, us bigint, exposure double, wb double, sharpness_raw double, noise double, aesthetic double, composition double, faces {FACE}"


def verdicts(spark, values, chosen):
    df = spark.createDataFrame([(1, i, i, float(v)) for i, v in enumerate(values)], "group_id bigint, photo_id bigint, us bigint, value double")
    return [r["photo_id"] for r in chosen(df).where("verdict = 'kept'").orderBy("rank").collect()]


@pytest.mark.parametrize("values, kept", [([0.9, 0.5, 0.4], 1), ([0.90, 0.88, 0.86, 0.40], 3), ([0.85] * 10, 5), ([], 0), ([0.3], 1), ([0.0, 0.0], 1 + 0)])
def test_auto_k(spark, values, kept):
    assert len(verdicts(spark, values, select.top_auto)) == kept


def test_top_k_ties_and_no_numbers(spark):
    assert verdicts(spark, [0.5, 0.7, 0.7, float("nan")], lambda d: select.top_k(d, 2)) == [1, 2]
    assert verdicts(spark, [0.5, float("nan")], lambda d: select.top_k(d, 9)) == [0, 1]
    assert verdicts(spark, [0.5], lambda d: select.top_k(d, 0)) == []


def scored(spark, *members):
    rows = select.scored(spark.createDataFrame(members, MEMBER)).collect()
    return {r["photo_id"]: r for r in rows}


def test_alone_is_neutral_and_unscored_is_left_out(spark):
    got = scored(spark, (1, 1, 0, 0.8, 0.8, 9.0, 0.8, None, None, None), (2, 2, 0, None, 0.8, 9.0, 0.8, 1.0, 1.0, []))
    assert set(got) == {1}
    assert got[1]["sharpness"] == 0.5 and got[1]["aesthetic"] == 0.5 and got[1]["scene"] == "landscape"
    assert got[1]["tech"] == pytest.approx(0.3 * 0.8 + 0.2 * 0.8 + 0.35 * 0.5 + 0.15 * 0.8)
    assert got[1]["value"] == pytest.approx(0.35 * got[1]["tech"] + 0.65 * 0.5)


def test_sharper_scores_higher_and_equal_ones_alike(spark):
    got = scored(spark, *((1, i, 0, 0.8, 0.8, s, 0.8, 0.5, 0.5, []) for i, s in enumerate((1.0, 2.0, 3.0))))
    assert got[0]["value"] < got[1]["value"] < got[2]["value"]
    got = scored(spark, *((1, i, 0, 0.8, 0.8, 4.0, 0.8, 0.5, 0.5, []) for i in range(2)))
    assert got[0]["sharpness"] == got[1]["sharpness"] == 0.5


def test_open_eyes_beat_a_sharper_closed_face(spark):
    got = scored(spark, (1, 1, 0, 0.8, 0.8, 5.0, 0.8, 0.5, 0.5, [(0.2, 0.95, None, 50.0)]), (1, 2, 0, 0.8, 0.8, 5.0, 0.8, 0.5, 0.5, [(0.2, 0.05, None, 90.0)]))
    assert got[1]["value"] > got[2]["value"]


def test_one_face_in_a_group_has_neutral_sharpness(spark):
    got = scored(spark, (1, 1, 0, 0.8, 0.8, 5.0, 0.8, 0.5, 0.5, [(0.05, None, None, 1e9)]), (1, 2, 0, 0.8, 0.8, 5.0, 0.8, 0.5, 0.5, None))
    assert got[1]["face_bonus"] == pytest.approx((0.3 + 0.2 * 0.5) / 0.5)


def bonus(spark, faces):
    return spark.createDataFrame([(faces,)], f"faces {FACE}").select(scores.face_bonus(F.col("faces"))).first()[0]


def test_face_bonus(spark):
    assert bonus(spark, None) == bonus(spark, []) == 0.0
    assert bonus(spark, [(0.05, None, None, None)]) == pytest.approx(1.0)
    assert bonus(spark, [(0.05, 0.4, None, None)]) == pytest.approx((0.3 + 0.16) / 0.7)
    assert bonus(spark, [(0.05, 0.2, None, None)]) == 0.0
    assert bonus(spark, [(0.05, 0.9, None, None)] * 4 + [(0.05, 0.1, None, None)]) == pytest.approx((4 * 0.66 + 0.34) / 0.7 / 5)


@pytest.mark.parametrize("n, area, scene, face", [(0, 0.0, "landscape", 0.0), (1, 0.25, "portrait", 0.35), (1, 0.01, "mixed", 0.18), (1, 0.035, "mixed", 0.265), (2, 0.05, "portrait", 0.35), (1, 0.02, "mixed", 0.18)])
def test_scene_and_weights(spark, n, area, scene, face):
    r = spark.range(1).select(scores.scene(F.lit(n), F.lit(area)).alias("s"), *(scores.weight(p, F.lit(n), F.lit(area)).alias(p) for p in scores.PARTS)).first()
    assert r["s"] == scene and r["face"] == pytest.approx(face)
    assert sum(r[p] for p in scores.PARTS) == pytest.approx(1.0)


def test_plan_with_and_without_compositions(spark):
    groups = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (4, 4)], "group_id bigint, photo_id bigint")
    picks = spark.createDataFrame([(1, 1, "kept"), (1, 2, "rejected"), (4, 4, "rejected")], "group_id bigint, photo_id bigint, verdict string")
    photos = spark.createDataFrame([(i, f"/x/{i}.jpg") for i in (1, 2, 3, 4)], "photo_id bigint, path string")
    alone = {r["photo_id"]: r["dest"] for r in plan.with_destination(plan.planned(groups, picks), photos).collect()}
    assert alone == {1: "picked/group_00000001/1.jpg", 2: "rejected/2.jpg", 3: "picked/group_00000003/3.jpg", 4: "rejected/4.jpg"}
    made = spark.createDataFrame([(1, 1, "kept")], "composition_id bigint, photo_id bigint, verdict string")
    both = {r["photo_id"]: r["dest"] for r in plan.with_destination(plan.planned(groups, picks, made), photos).collect()}
    assert both == {1: "picked/comp_00000001/1.jpg", 2: "rejected/2.jpg", 3: "rejected/3.jpg", 4: "rejected/4.jpg"}
    c = report.counters(groups, picks, plan.planned(groups, picks)).first()
    assert (c["photo_count"], c["burst_count"], c["composition_count"], c["picked_count"], c["rejected_count"]) == (4, 3, 0, 2, 2)
    c = report.counters(groups, picks, plan.planned(groups, picks, made), made).first()
    assert (c["composition_count"], c["picked_count"], c["rejected_count"]) == (1, 1, 3)


def test_review_splits_photos_in_two(spark):
    r = random.Random(0)
    picks = [(i, r.choice(("kept", "rejected"))) for i in range(50)]
    over = [r.randrange(60) for _ in range(20)]
    got = {x["photo_id"]: x["keep"] for x in plan.reviewed(spark.createDataFrame(picks, "photo_id bigint, verdict string"), spark.createDataFrame([(o,) for o in [*over, None]], "photo_id bigint")).collect()}
    assert got == {i: (v == "kept") != (i in over) for i, v in picks}


def test_report_page(spark):
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "group_id bigint, photo_id bigint")
    picks = spark.createDataFrame([(1, 2, 1, "kept", 0.9), (1, 1, 2, "rejected", 0.2)], "group_id bigint, photo_id bigint, rank int, verdict string, value double")
    text = report.page(report.nested(groups, picks), "<cull>")
    assert "&lt;cull&gt;" in text and text.index(">2 kept #1") < text.index(">1 rejected #2") < text.index(">3 unscored")


def test_cache(spark):
    row = "content_key string, schema_version int, embedding array<double>, faces array<double>, created_at bigint"
    old = spark.createDataFrame([("a", 4, [1.0], [], 1), ("b", 3, [1.0], [], 1), ("c", 4, None, [], 1), ("d", 4, [1.0], None, 1)], row)
    photos = spark.createDataFrame([(k,) for k in "abcde"] + [(None,)], "content_key string")
    miss = lambda **k: {r["content_key"] for r in cache.probed(photos, old, **k).where("miss").collect()}
    assert miss() == {"b", "c", "d", "e", None}
    assert miss(embeddings=False, faces=False) == {"b", "e", None}
    fresh = spark.createDataFrame([("b", [2.0], [], 7), ("e", None, None, 7), ("e", [3.0], None, 8)], "content_key string, embedding array<double>, faces array<double>, created_at bigint")
    got = {r["content_key"]: (r["schema_version"], r["created_at"]) for r in cache.upserted(old, fresh).collect()}
    assert got == {"a": (4, 1), "b": (4, 7), "c": (4, 1), "d": (4, 1), "e": (4, 8)}
    hits = cache.probed(photos.where("content_key = 'a'"), old)
    assert cache.composed_by_cache(hits, False, False) and not cache.composed_by_cache(cache.probed(photos, old), False)


def test_snapshot_keeps_last_ticks(spark):
    log = [("r", 1, "stage", "scan", 0), ("r", 2, "tick", "scan", 5), ("r", 3, "tick", "scan", 9), ("r", 4, "finish", "scan", 9), ("r", 5, "stage", "rank", 0), ("r", 6, "tick", "rank", 1), ("r", 7, "done", None, None)]
    got = report.snapshot(spark.createDataFrame(log, "run_id string, seq bigint, kind string, stage string, done bigint"))
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4, 5, 6, 7]


def test_export_names_do_not_meet(spark):
    names = ["a.jpg", "a (2).jpg", "a.jpg", "a.jpg", "a (2).jpg", "b.jpg", "README", "README", "x", ".hidden", ".hidden"]
    got = [r["exported"] for r in sinks.export_names(spark.createDataFrame(list(enumerate(names)), "photo_id bigint, name string"), taken=["x"]).orderBy("photo_id").collect()]
    from burstframe.functions.strings import unused_name

    used = {"x"}
    assert got == [unused_name(n, used) for n in names]
    assert got[:4] == ["a.jpg", "a (2).jpg", "a (3).jpg", "a (4).jpg"] and got[7] == "README (2)" and got[8] == "x (2)"


def test_materialise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / f"in/{n}.jpg").write_text(n)
    photos = spark.createDataFrame([(1, f"file:{tmp_path}/in/a.jpg"), (2, f"file:{tmp_path}/in/b.jpg")], "photo_id bigint, path string")
    todo = spark.createDataFrame([(1, "picked", "picked/group_00000001/a.jpg"), (2, "rejected", "rejected/b.jpg")], "photo_id bigint, verdict string, dest string")
    for mode in ("copy", "hardlink", "symlink", "copy"):
        assert {r["verdict"]: r["files"] for r in sinks.materialise(todo, photos, str(tmp_path / "out"), mode).collect()} == {"picked": 1, "rejected": 1}
        assert (tmp_path / "out/picked/group_00000001/a.jpg").read_text() == "a"
    assert (tmp_path / "in/a.jpg").read_text() == "a"


def test_configuration():
    assert CullConfig().preset_name() == "balanced" and CullConfig.preset("gentle").k1 == 5
    assert CullConfig(k1=4).preset_name() == "custom" and CullConfig(burst_similarity=0.95 + 1e-9).preset_name() == "balanced"
    assert all(p.validated().preset_name() == n for n, p in PRESETS.items())
    for bad in ({"k1": 0}, {"k2": 11}, {"burst_similarity": 0.5}):
        with pytest.raises(ValueError):
            CullConfig(**bad).validated()
    assert source_of("x") == ("directory", "x") and source_of(None, ["a"]) == ("files", ["a"])
    for both in (("x", ["a"]), (None, None), (None, [])):
        with pytest.raises(ValueError):
            source_of(*both)
    assert [thumbnail_edge(e) for e in (1, 1000, 9999)] == [512, 1000, 4096]
    assert not math.isnan(CullConfig().time_k)
