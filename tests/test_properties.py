"""Properties that hold whatever the input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from burstframe.functions import pixels
from burstframe.functions.strings import unused_name
from burstframe.operators.compositions import peel
from burstframe.sources.photos import metadata, preview, scanned_preview

images = st.integers(1, 40).flatmap(lambda h: st.integers(1, 40).flatmap(lambda w: st.binary(min_size=h * w * 3, max_size=h * w * 3).map(lambda b: np.frombuffer(b, np.uint8).reshape(h, w, 3))))


@settings(max_examples=60, deadline=None)
@given(images, st.one_of(st.none(), st.floats(-5, 5)), st.one_of(st.none(), st.integers(0, 100_000)))
def test_scores_lie_between_nought_and_one(rgb, ev, iso):
    grey = pixels.luma(rgb)
    for s in (pixels.exposure(grey, ev), pixels.white_balance(rgb), pixels.noise(grey, iso), pixels.aesthetic(rgb), pixels.composition(rgb)):
        assert 0.0 <= s <= 1.0
    assert pixels.sharpness(grey) >= 0.0 and pixels.oriented(pixels.oriented(rgb, 6), 8).tobytes() == rgb.tobytes()


@given(st.lists(st.text(alphabet="ab.( )2", min_size=1, max_size=8), max_size=30))
def test_names_never_meet(names):
    used: set[str] = set()
    out = [unused_name(n, used) for n in names]
    assert len(set(out)) == len(out) == len(used)


@given(st.binary(max_size=200))
def test_any_header_can_be_read(content):
    assert set(metadata(content)) == {"captured_at", "iso", "exposure_bias_ev", "orientation"}
    for order in (b"II*\0\x08\0\0\0", b"MM\0*\0\0\0\x08"):
        assert metadata(order + content)["orientation"] in range(1, 9)
        preview(order + content)


@given(st.lists(st.sampled_from([b"\xff\xd8", b"\xff\xd9", b"\xff", b"x"]), max_size=40).map(b"".join))
def test_scanned_previews_are_whole(content):
    found = scanned_preview(content)
    assert found is None or (found[:2] == b"\xff\xd8" and found[-2:] == b"\xff\xd9" and found in content and b"\xff\xd9" not in found[2:-2])


@settings(deadline=None)
@given(st.lists(st.floats(0, 6.28), min_size=1, max_size=12), st.floats(0.1, 0.99))
def test_what_is_left_of_a_cluster_is_near_its_middle(angles, limit):
    v = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    out = peel(v, limit)
    core = v[~out]
    assert len(core) >= 1
    if len(core) > 1:
        middle = core.mean(axis=0)
        assert (core @ (middle / max(np.linalg.norm(middle), 1e-8)) >= limit - 1e-9).all()
