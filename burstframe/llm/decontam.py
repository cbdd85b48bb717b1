"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of benchmark words. A window of ``words`` words is taken at every word,
so any leaked passage of ``words`` words is found; an item of fewer words is one pattern, however
short. Texts and items are compared in lower case with each run of white space as one blank,
at word boundaries. Patterns go to the workers in parts of a bounded size, one pass over the texts for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import texts

WORDS = 13
BLOCK = 8
TABLE_BITS = 20
#: Patterns in one automaton; more are searched by several automata in the same pass over the texts.
MOST_PATTERNS = 50_000
#: Patterns of one pass over the texts, and so in one broadcast (13 words are 80 bytes or so). More take more passes.
PER_PASS = 200_000
#: Patterns of very different lengths are searched apart, since the shortest decides how far a search can skip.
CLASSES = (8, 32, 64)
LANE = 4096


def normalised(text: Column) -> Column:
    """Lower case, blanks between words, one blank at either end; null stays null."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\f\r]+", " ")), F.lit(" "))


def windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(pattern, item_id): the distinct windows of every item, or the whole of a shorter one. Null and empty items have none."""
    w = F.filter(F.split(normalised(F.col("text")), " "), lambda x: x != "")
    items = benchmark.select("item_id", w.alias("w")).where(F.size("w") > 0)
    places = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - words, F.lit(0)) + 1))
    return items.select("item_id", "w", places.alias("i")).select(F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("i"), words), " "), F.lit(" ")).alias("pattern"), "item_id").distinct()


class WuManber:
    """Shift table over hashed blocks of 8 bytes (of the shortest pattern's length, if that is less), suffix buckets, direct comparison."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = block = min(m, BLOCK)
        self.mask = np.uint64((1 << 8 * block) - 1)
        heads = np.zeros((len(patterns), m + BLOCK), np.uint8)
        heads[:, :m] = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << TABLE_BITS, m - block + 1, np.int32)
        for j in range(block, m + 1):
            np.minimum.at(self.shift, self._slot(self._read(heads, j - block)), m - j)
        suffix = self._read(heads, m - block)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _read(self, heads: np.ndarray, at: int) -> np.ndarray:
        return np.ascontiguousarray(heads[:, at : at + BLOCK]).view("<u8")[:, 0] & self.mask

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(texts._P)) >> np.uint64(64 - TABLE_BITS)

    def search(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in ``data``.

        The positions are split into lanes that move on together: each step looks up the
        block that ends at every lane's position and moves the lane by its shift.
        """
        n, m = len(data), self.m
        if n < m:
            return []
        back = self.block - 1
        blocks = np.ndarray((n,), "<u8", np.append(data, np.zeros(BLOCK, np.uint8)), strides=(1,))
        at = np.arange(m - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            step = self.shift[self._slot(blocks[at - back] & self.mask)]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        if not found:
            return []
        at = np.concatenate(found)
        keys = blocks[at - back] & self.mask
        low, high = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        some = high > low
        out = []
        for p, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist()):
            start = p - m + 1
            for k in self.order[a:b].tolist():
                pattern = self.patterns[k]
                if data[start : start + len(pattern)].tobytes() == pattern:
                    out.append((start, k))
        return out


def _automata(patterns: list[bytes]) -> list[tuple[list[int], WuManber]]:
    """Automata of at most MOST_PATTERNS patterns of similar length, with the numbers of their patterns."""
    order = sorted(range(len(patterns)), key=lambda i: len(patterns[i]))
    cuts = [0, *np.searchsorted([len(patterns[i]) for i in order], CLASSES).tolist(), len(order)]
    parts = [order[i : min(i + MOST_PATTERNS, hi)] for lo, hi in zip(cuts, cuts[1:]) for i in range(lo, hi, MOST_PATTERNS)]
    return [(part, WuManber([patterns[k] for k in part])) for part in parts]


def matches(column: pa.Array, automata: list) -> Iterator[tuple[int, int]]:
    """(row, pattern) of every occurrence in a column of normalised texts."""
    for a, b in texts.chunks(column, 8 << 20):
        data, offsets = texts.buffers(column.slice(a, b - a))
        for ids, automaton in automata:
            for start, k in automaton.search(data):
                # A text begins and ends in a blank and holds no two blanks, so no pattern spans two texts.
                yield a + int(np.searchsorted(offsets, start, "right")) - 1, ids[k]


_built: dict = {}


def _automata_of(patterns: list[bytes]) -> list[tuple[list[int], WuManber]]:
    """Built once for a worker, whatever tasks it gets; those of the last pass are kept."""
    key = hash(tuple(patterns))
    if key not in _built:
        _built.clear()
        _built[key] = _automata(patterns)
    return _built[key]


def _passes(benchmark: DataFrame, words: int, per_pass: int) -> Iterator[tuple[list[bytes], list[list]]]:
    """Patterns, and for each the items that hold it, in parts of ``per_pass`` patterns; the driver holds one part at a time."""
    patterns, items = [], []
    for pattern, item in windows(benchmark, words).orderBy("pattern", "item_id").toLocalIterator():
        p = pattern.encode()
        if not patterns or patterns[-1] != p:
            if len(patterns) == per_pass:
                yield patterns, items
                patterns, items = [], []
            patterns.append(p)
            items.append([])
        items[-1].append(item)
    if patterns:
        yield patterns, items


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, per_pass: int = PER_PASS) -> DataFrame:
    """(doc_id, item_id, n_windows): how many distinct windows of an item a document holds.

    A row of ``docs`` without a window gives no row, nor does a null or empty text, nor an empty
    table of documents or items. Rows that repeat give repeated results; a null doc_id or item_id is carried, and
    texts of any length are searched whole. Other columns are not read.
    """
    schema = "doc_id bigint, item_id bigint, n_windows bigint"
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("bigint"), normalised(F.col("text")).alias("text"), F.lit(None).cast("bigint").alias("row"))
    out, passes = None, 0
    for part in _passes(benchmark, words, per_pass):
        passes += 1
        if out is None and len(part[0]) == per_pass:
            # There may be more passes: rows get a number, stored so that all passes see the same, and counts are added up by it.
            rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        shared = sc.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns, items = shared.value
            automata = _automata_of(patterns)
            for batch in batches:
                seen: dict[tuple, set] = {}
                for row, k in matches(batch.column(1), automata):
                    for item in items[k]:
                        seen.setdefault((row, item), set()).add(k)
                keys = list(seen)
                at = pa.array([r for r, _ in keys], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([i for _, i in keys], pa.int64()), pa.array([len(seen[k]) for k in keys], pa.int64()), batch.column(2).take(at)], names=["doc_id", "item_id", "n_windows", "row"])

        found = rows.mapInArrow(search, schema + ", row bigint")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.drop("row") if passes == 1 else out.groupBy("row", "doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows")).drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, per_pass: int = PER_PASS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with all their columns.

    Rows with null or empty texts stay. Works by row, so ids may be null or repeat, and columns may
    have any names. Empty tables are no special case.
    """
    schema = docs.schema
    at = docs.columns.index("text")
    sc = docs.sparkSession.sparkContext
    out = docs
    for part in _passes(benchmark, words, per_pass):
        shared = sc.broadcast(part)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automata = _automata_of(shared.value[0])
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _ in matches(batch.column(batch.num_columns - 1), automata):
                    keep[row] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        out = out.select("*", normalised(out[out.columns[at]]).alias("__normalised")).mapInArrow(clean, schema)
    return out


def oracle(words: int = WORDS) -> str:
    squeeze = r"trim(regexp_replace(lower(text), '[ \t\n\f\r]+', ' ', 'g'))"
    return f"""
    WITH w AS (SELECT item_id, string_split({squeeze}, ' ') AS w FROM benchmark WHERE text IS NOT NULL AND {squeeze} <> ''),
    s AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - {words}, 0) + 1)) AS i FROM w),
    p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i + 1 : i + {words}], ' ') || ' ' AS pattern FROM s),
    d AS (SELECT doc_id, ' ' || {squeeze} || ' ' AS t FROM documents)
    SELECT doc_id, item_id, count(*) AS n_windows FROM d JOIN p ON contains(t, pattern) GROUP BY doc_id, item_id"""
