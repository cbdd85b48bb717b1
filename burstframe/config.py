"""Parameters of a culling run, their named presets and their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CullConfig:
    """All knobs. ``k2`` None or 0 lets score gaps decide how many a composition keeps."""

    time_k: float = 3.0
    min_dt: float = 0.3
    max_dt: float = 30.0
    hash_distance: int = 6
    burst_similarity: float = 0.95
    composition_similarity: float = 0.93
    chain_margin: float = 0.05
    adaptive_thresholds: bool = True
    k1: int = 3
    k2: int | None = None
    embeddings: bool = True
    faces: bool = True
    w_exposure: float = 0.30
    w_wb: float = 0.20
    w_sharpness: float = 0.35
    w_noise: float = 0.15

    @staticmethod
    def preset(name: str) -> CullConfig:
        return PRESETS[name]

    def validated(self) -> CullConfig:
        """The configuration itself, or a ValueError that names what is out of bounds."""
        for name, (low, high) in BOUNDS.items():
            value = getattr(self, name)
            if value is not None and not (name == "k2" and value == 0) and not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {value}")
        return self

    def preset_name(self) -> str:
        """The preset whose presented knobs this configuration has, else 'custom'."""
        return next((name for name, p in PRESETS.items() if all(_same(getattr(self, k), getattr(p, k)) for k in PRESENTED)), "custom")


BOUNDS = {"k1": (1, 20), "k2": (1, 10), "time_k": (0.5, 10), "burst_similarity": (0.7, 1), "composition_similarity": (0.7, 1), "hash_distance": (0, 32)}
PRESENTED = ("k1", "k2", "time_k", "burst_similarity", "composition_similarity", "embeddings", "faces", "adaptive_thresholds")
_BALANCED = CullConfig()
PRESETS = {
    "aggressive": replace(_BALANCED, k1=2, k2=1, burst_similarity=0.93, composition_similarity=0.90),
    "balanced": _BALANCED,
    "gentle": replace(_BALANCED, k1=5, burst_similarity=0.97, composition_similarity=0.95),
}


def _same(a: object, b: object) -> bool:
    return abs(a - b) < 1e-6 if isinstance(a, float) and isinstance(b, float) else a == b


def source_of(root: str | None = None, files: list[str] | None = None) -> tuple[str, object]:
    """('directory', root) or ('files', list): a run has the one or the other."""
    if (root is None) == (not files):
        raise ValueError("give either a directory or files")
    return ("directory", root) if root is not None else ("files", list(files))


def thumbnail_edge(edge: int) -> int:
    """A requested thumbnail edge within what may be asked for."""
    return min(max(int(edge), 512), 4096)


assert {*BOUNDS, *PRESENTED} <= {f.name for f in fields(CullConfig)}
