"""A whole culling run over tables: bursts, what each keeps, compositions, what they keep, the plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CullConfig, source_of
from .functions.scores import face_area
from .operators import bursts, cache, compositions, features as feature_rows, plan, report, select
from .session import cut, ensure_checkpoint_dir
from .sources import photos as photo_files, pictures

SIGNALS = ("exposure", "wb", "sharpness_raw", "noise", "aesthetic", "composition", "faces")


@dataclass(frozen=True)
class Cull:
    """The tables of a run; ``composition_picks`` is None where no compositions were made."""

    groups: DataFrame
    burst_picks: DataFrame
    composition_picks: DataFrame | None
    plan: DataFrame

    def counters(self) -> DataFrame:
        return report.counters(self.groups, self.burst_picks, self.plan, self.composition_picks)

    def reports(self) -> DataFrame:
        return report.nested(self.groups, self.burst_picks)

    def composition_reports(self) -> DataFrame | None:
        """Like ``reports``, of what compositions are made of; None where there are none."""
        made = self.composition_picks
        return None if made is None else report.nested(made.select("composition_id", "photo_id"), made, "composition_id")

    def page(self, **header: object) -> str:
        return report.page(self.reports(), header={**self.counters().first().asDict(), **header}, compositions=self.composition_reports())


def cull(photos: DataFrame, features: DataFrame, config: CullConfig = CullConfig()) -> Cull:
    """One run. ``photos`` has photo_id, us, burst_id and perhaps path; ``features`` photo_id, embedding, phash
    and the SIGNALS, with a struct of area, eye_open, smile and sharpness for each face.

    Photos without features or without a score take part as the plan says. Compositions are made
    of what bursts keep, if any of it has an embedding and the configuration asks for embeddings.
    """
    config = config.validated()
    t = bursts.thresholds(features.select("faces"), config).first()
    groups = cut(bursts.bursts(photos.select("photo_id", "us", "burst_id"), features, config, t["burst_similarity"]))
    members = groups.join(photos.select("photo_id", "us"), "photo_id").join(features.select("photo_id", *SIGNALS), "photo_id")
    picks = cut(select.top_k(select.scored(members, config), config.k1))
    made = None
    if config.embeddings:
        kept = picks.where("verdict = 'kept'").select("photo_id").join(features.select("photo_id", "embedding"), "photo_id")
        parts = compositions.compositions(kept, config, t["composition_similarity"])
        again = select.scored(members.drop("group_id", "representative").join(parts, "photo_id"), config, "composition_id")
        made = cut(select.select(again, config.k2, "composition_id"))
        made = None if made.isEmpty() else made
    return Cull(groups, picks, made, plan.planned(groups, picks, made))


@dataclass(frozen=True)
class FileRun:
    """A run over files: what it decided, the photos it found, how many came from the cache and how many were worked out, and seconds."""

    cull: Cull
    photos: DataFrame
    cached_count: int
    extracted_count: int
    elapsed_s: float

    def page(self) -> str:
        return self.cull.page(cached_count=self.cached_count, extracted_count=self.extracted_count, elapsed_s=round(self.elapsed_s, 3))


_STORED = "content_key string, schema_version int, phash bigint, dhash bigint, " + ", ".join(f"{s} double" for s in feature_rows.SCORES) + f", embedding array<double>, faces {cache.FACES}, created_at bigint"


def _shaped(rows: DataFrame) -> DataFrame:
    """Extracted features as runs and caches have them: faces by area, eyes, smile and sharpness."""
    if "faces" not in rows.columns:
        return rows.withColumns({"embedding": F.lit(None).cast("array<double>"), "faces": F.lit(None).cast(cache.FACES)})
    one = lambda f: F.struct(face_area(f["w"], f["h"]).cast("double").alias("area"), *(f[a].cast("double").alias(b) for a, b in (("eye_open_prob", "eye_open"), ("smile_prob", "smile"), ("local_sharpness", "sharpness"))))
    return rows.withColumns({"embedding": F.col("embedding").cast("array<double>"), "faces": F.transform("faces", one)})


def cull_files(
    spark: SparkSession, root: str | None = None, files: list[str] | None = None, config: CullConfig = CullConfig(), cache_path: str | None = None,
    embed: Callable | None = None, detect: Callable | None = None, preview_folder: str | None = None,
) -> FileRun:
    """From files to the plan: scan, look up the cache, decode what misses (raw photos by their embedded picture), extract, store, cull.

    ``embed`` and ``detect`` make an embedding and faces of a picture; what is wanted of them decides what misses. A photo that can't be decoded takes part
    without features. Equal contents that miss are worked out each and stored once. ``preview_folder`` is one that all machines share.
    """
    began = time.time()
    config = config.validated()
    kind, what = source_of(root, files)
    photos = cut(photo_files.scan_directory(spark, what) if kind == "directory" else photo_files.scan_files(spark, what))
    where = what if kind == "directory" else [r["path"] for r in photos.select("path").toLocalIterator()]
    old = cache.load(spark, cache_path) if cache_path else None
    old = spark.createDataFrame([], _STORED) if old is None else old
    probe = cut(cache.probed(photos, old, embed is not None and config.embeddings, detect is not None and config.faces))
    missing = probe.where("miss").select(*photos.columns)
    folder = preview_folder or f"{ensure_checkpoint_dir(spark).removeprefix('file://').removeprefix('file:')}/previews"
    images = pictures.decoded(spark, missing.where("format = 'jpeg'"), where)
    if not missing.where("format = 'raw'").isEmpty():
        shown = cut(pictures.previews(spark, missing, where, folder))
        if not shown.isEmpty():
            images = images.unionByName(pictures.decoded(spark, shown, folder))
    fresh = cut(_shaped(feature_rows.extracted(images, embed if config.embeddings else None, detect if config.faces else None)))
    names = [f.split()[0] for f in _STORED.split(", ")][2:-1]
    if cache_path:
        keyed = fresh.join(missing.select("photo_id", "content_key"), "photo_id").select("content_key", *names, F.lit(int(began * 1000)).alias("created_at"))
        cache.store(cache.upserted(old, keyed), cache_path)
    hits = probe.where("NOT miss").select("photo_id", *(F.col(f"c_{n}").alias(n) for n in names))
    made = replace(config, embeddings=cache.composed_by_cache(probe, embed is not None, config.embeddings))
    rows = photos.select("photo_id", F.unix_micros("captured_at").alias("us"), "burst_id", "path")
    run = cull(rows, cut(hits.unionByName(fresh.select("photo_id", *names))), made)
    cached, extracted = hits.count(), fresh.count()
    return FileRun(run, photos, cached, extracted, time.time() - began)
