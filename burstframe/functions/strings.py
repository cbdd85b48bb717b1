"""Column expressions over names and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW = ("cr2", "cr3", "nef", "arw", "dng", "pef", "orf", "raf")
JPEG = ("jpg", "jpeg", "jpe")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if there is none. A leading dot begins no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def photo_format(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*JPEG), "jpeg").when(e.isin(*RAW), "raw")


def raw_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*RAW), e)


def subsecond_ms(text: Column, compatible: bool = True) -> Column:
    """Milliseconds of a fraction of a second written as digits.

    The compatible way reads a whole number first, so leading zeros are lost ('050' is 500 ms); the
    other way keeps them. Anything that is no number up to 2**32 - 1 gives 0.
    """
    t = F.regexp_replace(F.trim(text), '^"+|"+$', "")
    number = F.when(t.rlike(r"^\+?[0-9]{1,10}$"), t.cast("bigint"))
    number = F.when(number < 2**32, number)
    digits = number.cast("string") if compatible else F.when(number.isNotNull(), F.regexp_replace(t, r"^\+", ""))
    return F.coalesce(F.substring(F.rpad(digits, 3, "0"), 1, 3).cast("int"), F.lit(0))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def content_key(content: Column) -> Column:
    """The first 16 bytes of SHA-256 as 32 hexadecimal digits."""
    return F.substring(F.sha2(content, 256), 1, 32)


def short_id(group_id: Column) -> Column:
    """Hexadecimal digits that name a group's folder, eight at least."""
    digits = F.lower(F.hex(group_id))
    return F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)


def destination(verdict: Column, composed: Column, group_id: Column, path: Column) -> Column:
    """Where a photo goes: picked/comp_<id>/name, picked/group_<id>/name or rejected/name."""
    folder = F.when(verdict != "picked", F.lit("rejected")).otherwise(F.concat(F.when(composed, F.lit("picked/comp_")).otherwise(F.lit("picked/group_")), short_id(group_id)))
    return F.concat_ws("/", folder, file_name(path))


#: A model's ranking of images, one to a line: a place and a picture in either order, then a mark and the reason.
PLACE, PICTURE, NEAR, REASON = r"(?:rank|排名|第)\s*#?\s*(\d+)", r"image\s*#?\s*(\d+)", r"[^\n]{0,40}?", r"[\s*_)]*[—–:-]\s*([^\n]+)"
RANK_FIRST, IMAGE_FIRST = ("(?i)" + a + NEAR + b + REASON for a, b in ((PLACE, PICTURE), (PICTURE, PLACE)))


def ranked_images(answer: Column) -> Column:
    """Array of (image, rank, reason): each image's first mention, lines that begin with the rank before the others."""
    found = []
    for pattern, rank, image in ((RANK_FIRST, 1, 2), (IMAGE_FIRST, 2, 1)):
        part = lambda i, p=pattern: F.regexp_extract_all(answer, F.lit(p), F.lit(i))
        found.append(F.transform(F.arrays_zip(part(image).alias("i"), part(rank).alias("r"), part(3).alias("t")), lambda z: F.struct(z["i"].cast("int").alias("image"), z["r"].cast("int").alias("rank"), F.regexp_replace(z["t"], r"^[\s*_]+|[\s*_]+$", "").alias("reason"))))
    every = F.concat(*found)
    return F.aggregate(every, F.filter(every, lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda k: k["image"] == x["image"]), kept).otherwise(F.concat(kept, F.array(x))))


def ranking_prompt(scene: str, total: int, language: str = "en") -> str:
    """What a vision model is asked for; its answer is read by ``ranked_images``."""
    tongue = "Simplified Chinese" if language == "zh" else "English"
    return (
        f"Attached are {total} photographs of one {scene} scene, numbered Image 1 to Image {total} as attached. "
        f"Order all of them by merit: focus on the subject, expression, framing, exposure, blur, distractions. "
        f"Write {total} lines in {tongue}, the best first, each as 'Rank <place> (Image <number>): <one observed reason>', and nothing else."
    )


_ENDING = re.compile(r"^(.+)\.([^.]*)$", re.S)


def unused_name(name: str, used: set[str]) -> str:
    """``name``, or with (2), (3) ... before its extension if that is taken; the result is then taken too."""
    m = _ENDING.match(name)
    stem, end = (m[1], "." + m[2]) if m else (name, "")
    out, n = name, 2
    while out in used:
        out, n = f"{stem} ({n}){end}", n + 1
    used.add(out)
    return out
