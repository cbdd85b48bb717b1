"""Pixel kernels in numpy: what a photo's picture says of it. Images are (height, width, 3) or (height, width) uint8 arrays."""

from __future__ import annotations

import numpy as np

ROI_LEAST = 64


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey of an RGB image in whole thousandths, rounded down."""
    return (rgb.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def exposure(grey: np.ndarray, ev: float | None = None) -> float:
    if not grey.size:
        return 0.0
    p = np.bincount(grey.ravel(), minlength=256) / grey.size
    some = p[p > 0]
    entropy = min(max(float(-(some * np.log2(some)).sum()) / 8, 0.0), 1.0)
    s = 0.4 * entropy + 0.3 * (1 - min(p[250:].sum() / 0.01, 1.0)) + 0.2 * (1 - min(p[:6].sum() / 0.05, 1.0)) + 0.1 * p[64:193].sum()
    if ev is not None and abs(ev) > 1.5:
        s -= 0.1
    return float(min(max(s, 0.0), 1.0))


def saturation_and_hue(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation (0..1) and the hue's bin of ten degrees (0..35) of each pixel."""
    c = rgb.reshape(-1, 3).astype(np.int64)
    r, g, b = c.T
    top, low = c.max(axis=1), c.min(axis=1)
    d = top - low
    s = np.where(top > 0, d / np.maximum(top, 1), 0.0)
    safe = np.maximum(d, 1)
    sixth = np.where(top == r, np.mod((g - b) / safe, 6.0), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
    return s, np.where(d > 0, np.floor(6 * sixth + 1e-9), 0).astype(np.int64) % 36


def hue_entropy(s: np.ndarray, bin_: np.ndarray, most: float) -> float:
    """Entropy of the hues, weighed by saturation where that is above a tenth, over ``most``; 0 for a total weight up to 1."""
    on = s > 0.1
    weight = np.bincount(bin_[on], s[on], 36)
    total = weight.sum()
    if total <= 1:
        return 0.0
    p = weight[weight > 0] / total
    return float(min(max(-(p * np.log(p)).sum() / most, 0.0), 1.0))


def white_balance(rgb: np.ndarray) -> float:
    if not rgb.size:
        return 0.0
    r, g, b = rgb.reshape(-1, 3).mean(axis=0)
    if g < 1:
        return 0.5
    raw = float(np.exp(-max(abs(r - g), abs(b - g)) / g / 0.15))
    return min(max(raw + (1 - raw) * hue_entropy(*saturation_and_hue(rgb), float(np.log(36))), 0.0), 1.0)


def laplacian(grey: np.ndarray) -> np.ndarray:
    """Four times each inner pixel less its four neighbours."""
    g = grey.astype(np.int64)
    return 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]


def laplacian_variance(grey: np.ndarray) -> float:
    return float(laplacian(grey).var()) if min(grey.shape) >= 3 else 0.0


def gradient_mean(grey: np.ndarray) -> float:
    """Mean Sobel magnitude of the inner pixels."""
    if min(grey.shape) < 3:
        return 0.0
    g = grey.astype(np.int64)
    across = g[:, 2:] - g[:, :-2]
    down = g[2:] - g[:-2]
    sx = across[:-2] + 2 * across[1:-1] + across[2:]
    sy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    return float(np.sqrt(sx * sx + sy * sy).mean())


def regions(w: int, h: int) -> list[tuple[int, int, int]]:
    """(x, y, size) of the nine squares that sharpness looks at; in an image smaller than a square, what there is of it."""
    size = max(min(w, h) // 3, ROI_LEAST)
    place = lambda k, n: min(max(k * n // 6 - size // 2, 0), max(n - size, 0))
    return [(place(kx, w), place(ky, h), size) for ky in (1, 3, 5) for kx in (1, 3, 5)]


def sharpness(grey: np.ndarray) -> float:
    h, w = grey.shape
    cuts = (grey[y : y + s, x : x + s] for x, y, s in regions(w, h))
    return max([0.0, *(0.6 * laplacian_variance(c) + 0.4 * gradient_mean(c) for c in cuts)])


def noise_sigma(grey: np.ndarray) -> float:
    """Root of the mean variance of the flattest twentieth of all 8 by 8 patches."""
    h, w = grey.shape[0] // 8 * 8, grey.shape[1] // 8 * 8
    if not h or not w:
        return 1.0
    v = np.sort(grey[:h, :w].astype(float).reshape(h // 8, 8, w // 8, 8).var(axis=(1, 3)).ravel())
    return float(np.sqrt(v[: max(len(v) // 20, 1)].mean()))


def noise(grey: np.ndarray, iso: int | None = None) -> float:
    expected = max(np.sqrt(max(100 if iso is None else iso, 50) / 100), 0.5)
    return float(min(expected / max(noise_sigma(grey), 0.5), 1.0))


def aesthetic(rgb: np.ndarray) -> float:
    h, w = rgb.shape[:2]
    if not h or not w:
        return 0.0
    stride = int(np.ceil(np.sqrt(max(w * h // 65536, 1))))
    part = rgb[::stride, ::stride]
    grey = np.sort(luma(part).ravel()).astype(float)
    n = len(grey)
    span = min(max((grey[n * 95 // 100] - grey[n * 5 // 100]) / 200, 0.0), 1.0) if n >= 20 else 0.5
    s, bin_ = saturation_and_hue(part)
    vivid = np.sort(s)[n // 2 :].mean() if n // 2 else 0.0
    return float(min(max(0.45 * span + 0.30 * hue_entropy(s, bin_, 3.58) + 0.25 * min(vivid, 1.0), 0.0), 1.0))


def _subject(mask: np.ndarray) -> tuple[float, float, float, float]:
    """Middle (x, y), share of the box around it, share of the image's sides that it comes near."""
    h, w = mask.shape
    y, x = np.nonzero(mask)
    mx, my = w // 30 + 1, h // 30 + 1
    near = sum(map(bool, (y.min() < my, y.max() + my >= h, x.min() < mx, x.max() + mx >= w)))
    return float(x.mean() / w), float(y.mean() / h), float((x.max() - x.min() + 1) * (y.max() - y.min() + 1) / (w * h)), near / 4


def subject(rgb: np.ndarray) -> tuple[float, float, float, float] | None:
    """The subject by edges, or by colour where edges are weak; None where both are."""
    h, w = rgb.shape[:2]
    if min(h, w) < 8:
        return None
    stride = max(max(w, h) // 256, 1)
    g = luma(rgb).astype(np.int64)
    ys, xs = np.arange(0, h, stride), np.arange(0, w, stride)
    if min(len(ys), len(xs)) < 4:
        return None
    at = lambda y, x: g[np.clip(y, 0, h - 1)][:, np.clip(x, 0, w - 1)]
    edges = np.abs(4 * at(ys, xs) - at(ys, xs - stride) - at(ys, xs + stride) - at(ys - stride, xs) - at(ys + stride, xs))
    if edges.max() >= 8:
        return _subject(edges >= max(edges.max() // 3, 4))
    c = rgb[ys][:, xs].astype(np.int64)
    top = c.max(axis=2)
    s = (top - c.min(axis=2)) * 255 // np.maximum(top, 1)
    if s.max() < 40:
        return None
    mask = s >= max(s.max() * 60 // 100, 30)
    return _subject(mask) if mask.sum() >= 4 else None


def composition(rgb: np.ndarray) -> float:
    found = subject(rgb)
    if found is None:
        return 0.5
    x, y, area, clipped = found
    away = min(np.hypot(x - a / 3, y - b / 3) for a in (1, 2) for b in (1, 2))
    s = 0.5 * np.exp(-away / 0.15) + 0.3 * np.exp(-((area - 0.25) ** 2) / (2 * 0.15**2)) + 0.2 * (1 - clipped)
    return float(min(max(s, 0.0), 1.0))


def _weights(source: int, target: int, reach: float, kernel) -> np.ndarray:
    scale = source / target
    wide = max(scale, 1.0)
    x = (np.arange(source)[None, :] + 0.5 - (np.arange(target)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(x) < reach, kernel(x), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int, lanczos: bool = False) -> np.ndarray:
    """The image at another size, by a triangle (or three-lobed Lanczos) filter as wide as the shrinkage."""
    kernel, reach = ((lambda x: np.sinc(x) * np.sinc(x / 3)), 3.0) if lanczos else ((lambda x: 1 - np.abs(x)), 1.0)
    rows, columns = _weights(image.shape[0], height, reach, kernel), _weights(image.shape[1], width, reach, kernel)
    out = np.einsum("yh,hwc->ywc", rows, image.reshape(*image.shape[:2], -1).astype(float))
    out = np.einsum("xw,ywc->yxc", columns, out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(height, width, *image.shape[2:])


def thumbnail(image: np.ndarray, longest: int = 1024) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    k = longest / max(h, w)
    return resized(image, max(int(w * k + 0.5), 1), max(int(h * k + 0.5), 1))


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned as its orientation (1 to 8) tells."""
    turn = {3: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(orientation, 0)
    out = np.rot90(image, turn) if turn else image
    return np.flipud(out) if orientation == 4 else np.fliplr(out) if orientation in (2, 5, 7) else out


def _bits(flags: np.ndarray) -> int:
    """64 flags as a number, the first the highest bit, in two's complement."""
    return int(np.packbits(flags.ravel()).view(">i8")[0])


def mean_hash(grey: np.ndarray) -> int:
    small = resized(grey, 8, 8).astype(float)
    return _bits(small > small.mean())


def gradient_hash(grey: np.ndarray) -> int:
    small = resized(grey, 9, 8).astype(int)
    return _bits(small[:, 1:] > small[:, :-1])


def embedding_input(rgb: np.ndarray, size: int = 224) -> np.ndarray:
    """A picture as an image-embedding model takes it: shorter side to ``size``, middle cut out, channels first, normalised."""
    h, w = rgb.shape[:2]
    k = size / max(min(w, h), 1)
    nw, nh = max(int(w * k + 0.5), size), max(int(h * k + 0.5), size)
    small = resized(rgb, nw, nh, lanczos=True)
    x, y = (nw - size) // 2, (nh - size) // 2
    mean, deviation = np.array([0.48145466, 0.4578275, 0.40821073]), np.array([0.26862954, 0.26130258, 0.27577711])
    return ((small[y : y + size, x : x + size] / 255 - mean) / deviation).transpose(2, 0, 1)[None].astype(np.float32)
