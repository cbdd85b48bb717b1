"""Faces from a detector's tensors: decoding, suppression of overlaps, back to the picture, and what each face shows.

A candidate is a row x1, y1, x2, y2, score and five points (right eye, left eye, nose, mouth's right and left corner) in the detector's square.
"""

from __future__ import annotations

import numpy as np

from .pixels import laplacian_variance, resized

SIDE, LEAST_SCORE, MOST_OVERLAP, STRIDES = 640, 0.6, 0.3, (8, 16, 32)


def letterboxed(rgb: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, tuple[float, int, int]]:
    """(1, 3, side, side) of blue, green, red from 0 to 255, the picture in the middle; scale and padding (x, y)."""
    h, w = rgb.shape[:2]
    scale = side / max(h, w)
    nw, nh = max(int(w * scale + 0.5), 1), max(int(h * scale + 0.5), 1)
    x, y = (side - nw) // 2, (side - nh) // 2
    out = np.zeros((1, 3, side, side), np.float32)
    out[0, :, y : y + nh, x : x + nw] = resized(rgb, nw, nh)[:, :, ::-1].transpose(2, 0, 1)
    return out, (scale, x, y)


def decoded(stride: int, cls: np.ndarray, obj: np.ndarray, box: np.ndarray, points: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Candidates of one stride whose class times objectness reaches LEAST_SCORE."""
    score = cls.ravel() * obj.ravel()
    k = np.flatnonzero(score >= LEAST_SCORE)
    middle = (np.stack([k % (side // stride), k // (side // stride)], axis=1) + 0.5) * stride
    reach = box.reshape(-1, 4)[k] * stride
    spots = middle[:, None] + points.reshape(-1, 5, 2)[k] * stride
    return np.concatenate([middle - reach[:, :2], middle + reach[:, 2:], score[k, None], spots.reshape(-1, 10)], axis=1)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of one box with others; 0 where the union is nothing."""
    inner = np.prod(np.maximum(np.minimum(a[2:4], b[:, 2:4]) - np.maximum(a[:2], b[:, :2]), 0), axis=1)
    area = lambda z: np.prod(np.maximum(z[..., 2:4] - z[..., :2], 0), axis=-1)
    union = area(a) + area(b) - inner
    return np.where(union > 0, inner / np.where(union > 0, union, 1), 0.0)


def suppressed(found: np.ndarray, most: float = MOST_OVERLAP) -> np.ndarray:
    """By descending score, those that overlap none kept before by more than ``most``."""
    kept: list[np.ndarray] = []
    for one in found[np.argsort(-found[:, 4], kind="stable")]:
        if not kept or (overlap(one, np.array(kept)) <= most).all():
            kept.append(one)
    return np.array(kept).reshape(-1, 15)


def _patch(grey: np.ndarray, x: int, y: int, size: int) -> np.ndarray | None:
    out = grey[max(y - size // 2, 0) :, max(x - size // 2, 0) :][:size, :size]
    return out if min(out.shape) >= 4 else None


def described(kept: np.ndarray, grey: np.ndarray, frame: tuple[float, int, int]) -> list[dict]:
    """Each face as x, y, w, h in shares of the picture, local_sharpness, eye_open_prob and smile_prob (None where unknown)."""
    h, w = grey.shape
    scale, px, py = frame
    out = []
    for one in kept:
        x1, x2 = (float(np.clip((v - px) / scale, 0, w)) / w for v in one[[0, 2]])
        y1, y2 = (float(np.clip((v - py) / scale, 0, h)) / h for v in one[[1, 3]])
        face = {"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1, "eye_open_prob": None, "smile_prob": None, "local_sharpness": None}
        bx, by = min(int(x1 * w), w - 1), min(int(y1 * h), h - 1)
        bw, bh = min(int(face["w"] * w), w - bx), min(int(face["h"] * h), h - by)
        if bw >= 8 and bh >= 8:
            face["local_sharpness"] = laplacian_variance(grey[by : by + bh, bx : bx + bw])
        spots = (one[5:].reshape(5, 2) - (px, py)) / scale
        at = [(min(int(sx), w - 1), min(int(sy), h - 1)) if sx >= 0 and sy >= 0 else None for sx, sy in spots]
        right, left, _, corner_r, corner_l = at
        if right and left:
            size = min(max(bw // 8, 8), 64)
            eyes = [_patch(grey, *e, size) for e in (right, left)]
            if all(e is not None for e in eyes):
                face["eye_open_prob"] = float(np.tanh(min(map(laplacian_variance, eyes)) / 40))
            apart = np.hypot(left[0] - right[0], left[1] - right[1])
            if corner_r and corner_l and apart > 8:
                mouth = np.hypot(corner_l[0] - corner_r[0], corner_l[1] - corner_r[1])
                face["smile_prob"] = float(1 / (1 + np.exp(-10 * (mouth / apart - 0.8))))
        out.append(face)
    return out


class ModelSession:
    """A local ONNX model, opened once for each worker process. No weights come with this package; a path is given."""

    _open: dict = {}

    def __init__(self, path: str):
        self.path = path

    def run(self, tensor: np.ndarray) -> list[np.ndarray]:
        if self.path not in self._open:
            import onnxruntime

            self._open[self.path] = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        session = self._open[self.path]
        return session.run(None, {session.get_inputs()[0].name: tensor})


def detected(rgb: np.ndarray, grey: np.ndarray, model: ModelSession) -> list[dict]:
    """Faces of a picture by a model with outputs cls, obj, box and points, each for the strides 8, 16 and 32."""
    tensor, frame = letterboxed(rgb)
    r = model.run(tensor)
    return described(suppressed(np.concatenate([decoded(s, r[k], r[3 + k], r[6 + k], r[9 + k]) for k, s in enumerate(STRIDES)])), grey, frame)


def embedded(rgb: np.ndarray, model: ModelSession) -> list[float]:
    """A picture's embedding of unit length."""
    from .pixels import embedding_input

    v = model.run(embedding_input(rgb))[0].ravel().astype(float)
    return (v / max(np.linalg.norm(v), 1e-8)).tolist()
