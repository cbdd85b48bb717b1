"""Where picked and rejected photos end up."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNTED = r" \([0-9]+\)"


def _split(name: str) -> tuple[str, str]:
    m = re.match(r"^(.+)(\.[^.]*)$", name, re.S)
    return (m[1], m[2]) if m else (name, "")


class _Names:
    """Names given so far in one family. It holds each name that is written as it is, and for each how far its numbers
    have come; numbered names are told from that, so many photos of one name take no memory."""

    def __init__(self, taken: Iterable[str] = ()) -> None:
        self.used, self.at = set(taken), {}

    def _numbered(self, name: str) -> bool:
        """Whether ``name`` is one of those that ``new`` made: all numbers from 2 up to where a name has come are taken."""
        stem, end = _split(name)
        m = re.match(r"^(.*) \(([0-9]+)\)$", stem, re.S)
        if not m or m[2][0] == "0" or len(m[2]) > 18:
            return False
        first = m[1] + end
        return 2 <= int(m[2]) < self.at.get(first, 2) and "%s (%s)%s" % (_split(first)[0], m[2], _split(first)[1]) == name

    def new(self, name: str) -> str:
        k = self.at.get(name)
        if k is None:
            free = name not in self.used and not (self.at and self._numbered(name))
            self.at[name] = 2
            if free:
                self.used.add(name)
                return name
            k = 2
        stem, end = _split(name)
        # A name's own numbers go up; only those of another can be in its way.
        others = len(self.at) > 1
        while (out := f"{stem} ({k}){end}") in self.used or others and self._numbered(out):
            k += 1
        self.at[name] = k + 1
        return out


def export_names(photos: DataFrame, taken: list[str] | None = None) -> DataFrame:
    """(photo_id, name, exported): names made different for one flat folder, in order of photo_id, beside those ``taken``.

    Names that can meet differ only in numbers in brackets, so each such family is named on its own;
    a task goes through its families in order, whatever their number.
    """
    root = F.regexp_replace("name", _COUNTED, "")
    before: dict[str, list[str]] = {}
    for t in taken or []:
        before.setdefault(re.sub(_COUNTED, "", t), []).append(t)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, names = None, _Names()
        for b in batches:
            out = []
            for f, n in zip(b.column("family").to_pylist(), b.column("name").to_pylist()):
                if f != family:
                    family, names = f, _Names(before.get(f, ()))
                out.append(names.new(n))
            yield pa.RecordBatch.from_arrays([b.column("photo_id"), b.column("name"), pa.array(out, pa.string())], names=["photo_id", "name", "exported"])

    rows = photos.where("name IS NOT NULL").select(F.col("photo_id").cast("bigint").alias("photo_id"), "name", root.alias("family"))
    return rows.repartition("family").sortWithinPartitions("family", F.col("photo_id").asc_nulls_last()).mapInArrow(name, "photo_id bigint, name string, exported string")


def place(source: str, target: str, mode: str = "copy") -> None:
    """Copy, hardlink (a copy where that fails) or symlink one file; a file that is there is replaced."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if os.path.lexists(target):
        os.remove(target)
    if mode == "symlink":
        os.symlink(os.path.abspath(source), target)
        return
    if mode == "hardlink":
        try:
            os.link(source, target)
            return
        except OSError:
            pass
    shutil.copyfile(source, target)


def materialise(plan: DataFrame, photos: DataFrame, root: str, mode: str = "copy") -> DataFrame:
    """(verdict, files): the plan (photo_id, verdict, dest) carried out below ``root``, a folder that all machines share."""
    rows = plan.join(photos.select("photo_id", "path"), "photo_id").select("verdict", "path", "dest")

    def carry(batches):
        for b in batches:
            for path, dest in zip(b["path"], b["dest"]):
                place(re.sub(r"^file:/*", "/", path), os.path.join(root, dest), mode)
            yield b[["verdict"]]

    return rows.mapInPandas(carry, "verdict string").groupBy("verdict").agg(F.count("*").alias("files"))
