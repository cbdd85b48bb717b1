import struct
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstframe.functions import faces, pixels, strings
from burstframe.operators import features
from burstframe.sources import photos


def grey(v, n=64):
    return np.full((n, n), v, np.uint8)


def board(cell, n=256):
    y, x = np.mgrid[:n, :n]
    return (((x // cell + y // cell) % 2) * 255).astype(np.uint8)


def test_exposure():
    ramp = np.tile(np.linspace(5, 250, 256).astype(np.uint8), (64, 1))
    assert pixels.exposure(grey(255)) < 0.3 and pixels.exposure(grey(0)) < 0.4 and pixels.exposure(ramp) > 0.6
    assert pixels.exposure(ramp, 2.0) == pytest.approx(pixels.exposure(ramp) - 0.1)
    assert pixels.exposure(np.zeros((0, 0), np.uint8)) == 0.0


def test_white_balance():
    flat = lambda *c: np.full((32, 32, 3), c, np.uint8)
    assert pixels.white_balance(flat(128, 128, 128)) == pytest.approx(1.0)
    assert pixels.white_balance(flat(200, 100, 100)) < 0.2
    assert pixels.white_balance(flat(9, 0, 0)) == 0.5
    hues = np.repeat(np.array([[230, 30, 30], [230, 230, 30], [30, 230, 30], [30, 230, 230], [30, 30, 230], [230, 30, 230]], np.uint8)[None], 10, 0).repeat(10, 1)
    assert pixels.white_balance(hues) > pixels.white_balance(flat(230, 30, 30)) + 0.3


def test_sharpness_and_noise():
    assert pixels.sharpness(grey(128, 128)) == 0.0
    assert pixels.sharpness(board(2)) > pixels.sharpness(board(4)) > pixels.sharpness(board(32)) > 0
    assert pixels.sharpness(grey(3, 10)) == 0.0
    noisy = (128 + np.random.default_rng(0).normal(0, 20, (128, 128))).clip(0, 255).astype(np.uint8)
    assert pixels.noise(grey(128, 128)) > 0.9 and pixels.noise(noisy) < 0.3 and pixels.noise(noisy, 6400) > pixels.noise(noisy, 100)
    assert pixels.noise_sigma(grey(1, 7)) == 1.0


def test_laplacian_against_loops():
    g = np.random.default_rng(1).integers(0, 256, (9, 11)).astype(np.uint8)
    v = [4 * int(g[y, x]) - int(g[y - 1, x]) - int(g[y + 1, x]) - int(g[y, x - 1]) - int(g[y, x + 1]) for y in range(1, 8) for x in range(1, 10)]
    assert pixels.laplacian_variance(g) == pytest.approx(np.var(v))


def disk(cx, cy, radius, n=300, on=(230, 230, 230), off=(20, 20, 20)):
    y, x = np.mgrid[:n, :n]
    return np.where(((x - cx * n) ** 2 + (y - cy * n) ** 2 < (radius * n) ** 2)[:, :, None], on, off).astype(np.uint8)


def test_composition():
    assert pixels.composition(np.full((300, 300, 3), 90, np.uint8)) == 0.5
    assert pixels.composition(disk(1 / 3, 1 / 3, 0.2)) > pixels.composition(disk(0.5, 0.5, 0.2)) > pixels.composition(disk(0.5, 0.5, 0.02))
    soft = disk(1 / 3, 1 / 3, 0.2, on=(160, 112, 128), off=(128, 128, 128))
    assert pixels.luma(soft).std() < 1 and pixels.composition(soft) > 0.6


def test_aesthetic():
    x = np.linspace(0, 1, 128)
    rainbow = (np.stack([np.abs(np.mod(6 * x + k, 6) - 3) - 1 for k in (0, 4, 2)], -1).clip(0, 1) * 255).astype(np.uint8)[None].repeat(64, 0)
    plain = np.full((64, 64, 3), 128, np.uint8)
    assert pixels.aesthetic(plain) < 0.3 and pixels.aesthetic(rainbow) > pixels.aesthetic(plain) + 0.2
    assert pixels.aesthetic(np.zeros((0, 4, 3), np.uint8)) == 0.0


def test_turning_and_sizes():
    a = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    for o, back in {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}.items():
        t = pixels.oriented(a, o)
        assert t.shape[:2] == ((3, 2) if o >= 5 else (2, 3)) and (pixels.oriented(t, back) == a).all()
    assert (pixels.oriented(a, 6)[0, -1] == a[0, 0]).all()
    assert pixels.thumbnail(np.zeros((2048, 1024, 3), np.uint8)).shape == (1024, 512, 3)
    assert pixels.thumbnail(a) is a
    assert (pixels.resized(np.full((10, 10, 3), 77, np.uint8), 3, 4) == 77).all()
    assert pixels.embedding_input(disk(0.5, 0.5, 0.2)).shape == (1, 3, 224, 224)


def test_hashes():
    g = pixels.luma(disk(0.3, 0.4, 0.2))
    assert pixels.mean_hash(g) == pixels.mean_hash(pixels.resized(g, 150, 150))
    assert pixels.mean_hash(g) != pixels.mean_hash(g.T.copy()) and -(2**63) <= pixels.gradient_hash(g) < 2**63
    assert pixels.mean_hash(grey(4)) == 0


def test_features_of_pictures(spark):
    p = disk(0.3, 0.3, 0.2, 80)
    rows = [(1, 80, 80, bytearray(p.tobytes()), 0.0, 100), (2, 80, 80, bytearray(b"short"), None, None), (3, 80, 80, None, None, None), (4, 0, 0, bytearray(), None, None)]
    images = spark.createDataFrame(rows, "photo_id bigint, width int, height int, rgb binary, ev double, iso int")
    got = features.extracted(images).collect()
    assert [tuple(r) for r in got] == [(1, *features.scores_of(p, 0.0, 100))]
    more = features.extracted(images, embed=lambda rgb: [1.0, 0.0], detect=lambda rgb, g: [{"x": 0.1, "y": 0.1, "w": 0.2, "h": 0.2, "eye_open_prob": None, "smile_prob": None, "local_sharpness": None}]).first()
    assert more["embedding"] == [1.0, 0.0] and more["faces"][0]["eye_open_prob"] is None


def test_faces_are_decoded_and_overlaps_go():
    n = 640 // 32
    cls, obj = np.zeros(n * n), np.ones(n * n)
    box, points = np.zeros((n * n, 4)), np.zeros((n * n, 10))
    for k, s in ((5 * n + 5, 0.9), (5 * n + 6, 0.8), (15 * n + 15, 0.7), (0, 0.5)):
        cls[k], box[k] = s, 2.0
    found = faces.decoded(32, cls, obj, box, points)
    assert len(found) == 3
    kept = faces.suppressed(found)
    assert kept[:, 4].tolist() == [0.9, 0.7]
    assert kept[0, :4].tolist() == [5.5 * 32 - 64, 5.5 * 32 - 64, 5.5 * 32 + 64, 5.5 * 32 + 64]
    assert faces.overlap(np.zeros(4), np.zeros((1, 4))).tolist() == [0.0]


def test_faces_come_back_to_the_picture():
    rgb = np.zeros((320, 640, 3), np.uint8)
    tensor, frame = faces.letterboxed(rgb + np.array([1, 2, 3], np.uint8))
    assert tensor.shape == (1, 3, 640, 640) and frame == (1.0, 0, 160) and tensor[0, :, 300, 300].tolist() == [3, 2, 1] and tensor[0, :, 10, 10].tolist() == [0, 0, 0]
    spots = [120, 220, 180, 220, 150, 240, 120, 270, 180, 270]
    one = faces.described(np.array([[100, 190, 200, 290, 0.9, *spots]], float), np.random.default_rng(0).integers(0, 256, (320, 640)).astype(np.uint8), frame)[0]
    assert (one["x"], one["y"]) == (100 / 640, 30 / 320) and one["w"] == pytest.approx(100 / 640)
    assert one["eye_open_prob"] == pytest.approx(1.0) and one["smile_prob"] == pytest.approx(1 / (1 + np.exp(-2)))
    flat = faces.described(np.array([[100, 190, 104, 194, 0.9, *spots]], float), grey(9, 640)[:320], frame)[0]
    assert flat["local_sharpness"] is None and flat["eye_open_prob"] == 0.0


def tiff(entries, more, order="<", ifd1=()):
    """A TIFF header with directories of (tag, kind, count, 4 bytes or longer data)."""
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)

    def directory(rows, at, following):
        body, extra, end = b"", b"", at + 2 + 12 * len(rows) + 4
        for tag, kind, n, value in rows:
            if len(value) > 4:
                value, extra = struct.pack(order + "I", end + len(extra)), extra + value
            body += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
        return struct.pack(order + "H", len(rows)) + body + struct.pack(order + "I", following) + extra

    size = len(directory([*entries, (0x8769, 4, 1, b"")], 8, 0))
    sub = directory(more, 8 + size, 0)
    after = directory(list(ifd1), 8 + size + len(sub), 0) if ifd1 else b""
    first = directory([*entries, (0x8769, 4, 1, struct.pack(order + "I", 8 + size))], 8, 8 + size + len(sub) if ifd1 else 0)
    return head + first + sub + after


def exif(order="<", subsec=b"050", **_):
    text = lambda s: (2, len(s) + 1, s + b"\0")
    p = order
    return tiff([(0x0112, 3, 1, struct.pack(p + "H", 6)), (0x0132, *text(b"2019:01:01 00:00:00"))], [(0x9003, *text(b"2024:05:06 07:08:09")), (0x8827, 3, 1, struct.pack(p + "H", 400)), (0x9204, 10, 1, struct.pack(p + "ii", -3, 2)), (0x9291, *text(subsec))], order)


def jpeg(t):
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(t) + 8) + b"Exif\0\0" + t + b"\xff\xda rest \xff\xd9"


@pytest.mark.parametrize("order", "<>")
def test_metadata(order):
    m = photos.metadata(jpeg(exif(order)))
    assert m == {"captured_at": datetime(2024, 5, 6, 7, 8, 9, 500_000, timezone.utc), "iso": 400, "exposure_bias_ev": -1.5, "orientation": 6}
    assert photos.metadata(exif(order), compatible=False)["captured_at"].microsecond == 50_000


@pytest.mark.parametrize("text, ms", [("5", 500), ("12", 120), ("050", 500), ("000", 0), ("123456", 123), ("x", 0), ("", 0), ("99999999999", 0)])
def test_fraction_of_a_second(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(strings.subsecond_ms(F.col("t"))).first()[0] == ms
    assert photos.metadata(exif(subsec=text.encode()))["captured_at"].microsecond == ms * 1000


@pytest.mark.parametrize("content", [b"", b"\xff\xd8", b"II*\0\xff\xff\xff\xff", b"MM\0*", jpeg(b"??"), exif()[:40], b"plain text"])
def test_unreadable_headers_give_nothing(content):
    assert photos.metadata(content)["captured_at"] is None


def test_previews():
    a, b = b"\xff\xd8" + b"a" * 5 + b"\xff\xd9", b"\xff\xd8" + b"b" * 9 + b"\xff\xd9"
    assert photos.scanned_preview(b"raw" + a + b"--" + b + b"\xff\xd8 open") == b
    assert photos.scanned_preview(b"raw" + a + a[:2] + b"c" * 5 + a[-2:]) == a
    assert photos.scanned_preview(b"nothing") is None
    t = tiff([], [], ifd1=[(0x0201, 4, 1, struct.pack("<I", 200)), (0x0202, 4, 1, struct.pack("<I", len(a)))])
    raw = t.ljust(200, b".") + a + b
    assert photos.listed_preview(raw) == a and photos.preview(raw) == a
    assert photos.preview(raw[: 200 + 3] + b"zz") is None


def test_scan(spark, tmp_path):
    root = tmp_path / "shoot"
    (root / "sub").mkdir(parents=True)
    for name, c in (("a.jpg", jpeg(exif())), ("b.JPEG", b"b"), ("sub/c.nef", b"c"), ("notes.txt", b"n"), (".hidden.jpg", b"h")):
        (root / name).write_bytes(c)
    got = {r["path"].rsplit("/", 1)[1]: r for r in photos.scan_directory(spark, str(root)).collect()}
    assert set(got) == {"a.jpg", "b.JPEG", "c.nef"} and len({r["content_key"] for r in got.values()}) == 3
    assert (got["c.nef"]["format"], got["c.nef"]["raw_kind"], got["a.jpg"]["iso"], got["b.JPEG"]["iso"], got["a.jpg"]["orientation"]) == ("raw", "nef", 400, None, 6)
    listed = photos.scan_files(spark, [str(root / "sub/c.nef"), str(root / "missing.jpg"), str(root / "notes.txt"), str(root / "a.jpg")]).orderBy("position").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["c.nef", "a.jpg"]
    for scan in (lambda: photos.scan_directory(spark, str(tmp_path / ".dark")), lambda: photos.scan_files(spark, [str(root / "notes.txt")]), lambda: photos.scan_files(spark, [])):
        with pytest.raises(photos.NoPhotos):
            scan()


def test_names_and_texts(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one(strings.html_escaped, '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert [one(strings.extension, p) for p in ("x/a.JPG", "x.y/a", ".jpg", "a.b.nef", None)] == ["jpg", "", "", "nef", None]
    assert one(strings.photo_format, "q.heic") is None
    got = one(strings.ranked_images, "**Rank 1 (Image 2)**: good *\nImage #3 – rank 2: *fine*\nRank 3 (Image 2): again\nnothing")
    assert [tuple(r) for r in got] == [(2, 1, "good"), (3, 2, "fine")]
    assert one(strings.ranked_images, "none") == [] and "Image 4" in strings.ranking_prompt("portrait", 4, "zh")
