"""Photo files as a table: scan, kind, content hash, metadata of the header, embedded previews."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import content_key, photo_format, raw_kind

#: Bytes of a raw file that are searched for an embedded JPEG.
MOST_SCANNED = 128 << 20

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class NoPhotos(ValueError):
    """A scan that found nothing usable."""


def _ifds(tiff: bytes) -> Iterator[dict[int, tuple]]:
    """The directories of a TIFF structure, one after another, as tag: (kind, values)."""
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    at, seen = struct.unpack_from(order + "I", tiff, 4)[0], set()
    while at and at not in seen and at + 2 <= len(tiff):
        seen.add(at)
        entries, at = _ifd(tiff, order, at)
        yield entries


def _ifd(tiff: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    count = struct.unpack_from(order + "H", tiff, at)[0]
    out = {}
    for k in range(count):
        tag, kind, n, _ = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * k)
        size = _SIZE.get(kind, 0) * n
        where = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, at + 2 + 12 * k + 8)[0]
        if not size or where + size > len(tiff):
            continue
        if kind in (1, 2, 7):
            out[tag] = (kind, tiff[where : where + n])
        elif kind in (5, 10):
            flat = struct.unpack_from(order + ("I" if kind == 5 else "i") * 2 * n, tiff, where)
            out[tag] = (kind, list(zip(flat[::2], flat[1::2])))
        else:
            out[tag] = (kind, list(struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind] * n, tiff, where)))
    end = at + 2 + 12 * count
    return out, struct.unpack_from(order + "I", tiff, end)[0] if end + 4 <= len(tiff) else 0


def tiff_of(content: bytes) -> bytes | None:
    """The TIFF structure with a file's metadata: the file itself, or a JPEG's APP1 segment."""
    if content[:2] in (b"II", b"MM"):
        return content
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack_from(">H", content, at + 2)[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _text(field: tuple | None) -> str | None:
    return field[1].split(b"\0")[0].decode("ascii", "replace") if field and field[0] == 2 else None


def metadata(content: bytes, compatible: bool = True) -> dict:
    """captured_at, iso, exposure_bias_ev and orientation (1 if unknown) of a file's header; what can't be read is None.

    Times have no zone and count as UTC. ``compatible``: see ``subsecond_ms``.
    """
    out = {"captured_at": None, "iso": None, "exposure_bias_ev": None, "orientation": 1}
    try:
        tiff = tiff_of(content)
        if tiff is None:
            return out
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        first = next(_ifds(tiff), {})
        pointer = first.get(0x8769)
        more = _ifd(tiff, order, pointer[1][0])[0] if pointer and pointer[0] == 4 else {}
    except (struct.error, KeyError, IndexError):
        return out
    both = first | more
    if (o := first.get(0x0112)) and o[0] == 3 and 1 <= o[1][0] <= 8:
        out["orientation"] = o[1][0]
    if (s := both.get(0x8827, both.get(0x8833))) and s[0] in (3, 4):
        out["iso"] = int(s[1][0])
    if (e := both.get(0x9204)) and e[0] == 10:
        n, d = e[1][0]
        out["exposure_bias_ev"] = n / d if d else float("nan") if not n else float("inf") * (1 if n > 0 else -1)
    stamp = next((t for tag in (0x9003, 0x9004, 0x0132) if tag in both and (t := _text(both[tag])) is not None), None)
    try:
        when = datetime.strptime(stamp or "", "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return out
    digits = (_text(both.get(0x9291)) or _text(both.get(0x9290)) or "").strip().strip('"')
    ms = 0
    if digits.isascii() and digits.isdigit() and int(digits) < 2**32:
        ms = int((str(int(digits)) if compatible else digits).ljust(3, "0")[:3])
    out["captured_at"] = when.replace(microsecond=ms * 1000)
    return out


def scanned_preview(content: bytes) -> bytes | None:
    """The longest JPEG within the first MOST_SCANNED bytes, the first of several; segments don't nest, and one without an end is the last."""
    data, at, best = content[:MOST_SCANNED], 0, None
    while (start := data.find(b"\xff\xd8", at)) >= 0 and (end := data.find(b"\xff\xd9", start + 2)) >= 0:
        at = end + 2
        if best is None or at - start > len(best):
            best = data[start:at]
    return best


def listed_preview(content: bytes) -> bytes | None:
    """The longest JPEG that the first three directories of a raw file's header name."""
    try:
        tiff, best = tiff_of(content), None
        for k, ifd in enumerate(_ifds(tiff) if tiff else ()):
            if k < 3 and 0x0201 in ifd and 0x0202 in ifd and (best is None or ifd[0x0202][1][0] > best[1]):
                best = (ifd[0x0201][1][0], ifd[0x0202][1][0])
    except (struct.error, KeyError, IndexError, TypeError):
        return None
    out = content[best[0] : best[0] + best[1]] if best else b""
    return out if best and len(out) == best[1] else None


def preview(content: bytes) -> bytes | None:
    """A raw file's embedded picture: as its header names it, or by search."""
    return listed_preview(content) or scanned_preview(content)


_META = "captured_at timestamp, iso int, exposure_bias_ev float, orientation int"


def described(files: DataFrame, compatible: bool = True) -> DataFrame:
    """``files`` (path, length, content) as photos: photo_id, path, format, raw_kind, captured_at, file_size, content_key,
    burst_id, drive_mode, iso, exposure_bias_ev, orientation. Other kinds of file are left out; a null content has neither key nor metadata.
    photo_id is a hash of the path; burst_id and drive_mode are null, since headers don't give them."""
    kind = pa.struct([("captured_at", pa.timestamp("us", "UTC")), ("iso", pa.int32()), ("exposure_bias_ev", pa.float32()), ("orientation", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = pa.array([metadata(c or b"", compatible) for c in b.column("content").to_pylist()], kind)
            names = [n for n in b.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *meta.flatten()], names=[*names, *kind.names])

    chosen = files.where(photo_format(F.col("path")).isNotNull())
    keyed = chosen.select("path", F.col("length").alias("file_size"), content_key(F.col("content")).alias("content_key"), "content")
    meta = keyed.mapInArrow(read, "path string, file_size bigint, content_key string, " + _META)
    return meta.select(
        F.xxhash64("path").alias("photo_id"), "path", photo_format(F.col("path")).alias("format"), raw_kind(F.col("path")).alias("raw_kind"), "captured_at", "file_size",
        "content_key", F.lit(None).cast("string").alias("burst_id"), F.lit(None).cast("string").alias("drive_mode"), "iso", "exposure_bias_ev", "orientation",
    )


def _path(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """The full address of a path on whatever file system it names, the path in it, and whether it is a file."""
    one = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = fs.makeQualified(one)
    return full.toString(), full.toUri().getPath(), fs.exists(full) and fs.getFileStatus(full).isFile()


def scan_directory(spark: SparkSession, root: str, compatible: bool = True) -> DataFrame:
    """Photos below a directory; names with a dot in front, the directory's own too, are passed over. NoPhotos if there are none.

    Files named with an underscore in front are hidden from Spark's listing; give those by ``scan_files``.
    """
    if os.path.basename(os.path.normpath(root)).startswith("."):
        raise NoPhotos(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Only names below the root count: a folder above it may well begin with a dot.
    below = _path(spark, root)[1].rstrip("/")
    hidden = F.expr("substring(path, locate('" + below.replace("'", "''") + "', path) + " + str(len(below)) + ")").rlike(r"/\.[^/]+")
    return _some(described(found.where(~hidden), compatible), root)


def scan_files(spark: SparkSession, paths: list[str], compatible: bool = True) -> DataFrame:
    """Photos of a list, with ``position`` in it; what is missing or of another kind is passed over. NoPhotos if nothing is left."""
    usable = [q for q, there in ((_path(spark, p)[0], _path(spark, p)[2]) for p in paths) if there]
    if not usable:
        raise NoPhotos("none of the files can be read")
    found = spark.read.format("binaryFile").load(usable)
    places = spark.createDataFrame([(re.sub("^file:/+", "file:/", p), k) for k, p in enumerate(usable)], "listed string, position int")
    out = described(found, compatible).join(places, F.regexp_replace("path", "^file:/+", "file:/") == F.col("listed")).drop("listed")
    return _some(out, str(paths))


def _some(photos: DataFrame, what: str) -> DataFrame:
    if photos.isEmpty():
        raise NoPhotos(what)
    return photos
