"""Repeated passages by suffix arrays.

A passage is ``WIDTH`` successive words (runs of ink). Suffix arrays are built for shards that
hold everything that may repeat, and nothing else: among the ``WIDTH - GRAM + 1`` word
``GRAM``-grams of a passage the one of least hash (the first at a tie) is its anchor, so equal
passages have equal anchors. The passages of one text with one anchor form a piece, a stretch of
its words; pieces whose anchor occurs nowhere else are dropped, equal pieces are one, and the rest are
dealt to shards by their anchor. A shard's array is made by induced sorting, and the common prefixes of
neighbouring suffixes, computed in text order, tell which of its passages occur twice. The few anchors
with more distinct pieces than a shard holds are spread over shards, and the hashes of their passages compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import texts

WIDTH, GRAM = 50, 12
#: Distinct pieces in a shard. An anchor with more is dealt to several shards, whose passages are then compared by hash.
PER_SHARD = 2_000
#: Larger alphabets are written in two digits.
ALPHABET = 1024
#: Strings that come up in recursion are sorted by doubling if they are no longer than SHORT, or longer than this share of the string they come from.
SHORT, SHRINK = 8192, 0.75


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n, rank, step = len(s), np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def _induce(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order given.

    Buckets (suffixes of one first symbol) are passed through from the least to place the larger
    type, and back to place the smaller type. What a bucket puts elsewhere moves as one array.
    """
    sa = np.zeros(len(t), np.int32)
    head, tail = starts.copy(), ends.copy()
    used = np.flatnonzero(ends > starts).tolist()
    seeds = leftmost[np.argsort(t[leftmost], kind="stable")]
    at = np.searchsorted(t[seeds], np.arange(len(starts) + 1)).tolist()
    count = np.arange(len(t) + 1, dtype=np.int32)

    def put(j: np.ndarray, right: bool) -> None:
        n = len(j)
        if n == 0:
            return
        keys = t[j]
        if n > 1:
            order = keys.argsort(kind="stable")
            j, keys = j[order], keys[order]
        # Each one's place among those of its bucket.
        new = np.empty(n + 1, bool)
        new[0] = new[n] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:n])
        first = new.nonzero()[0]
        size = first[1:] - first[:-1]
        place = count[:n] - np.repeat(first[:-1], size)
        key = keys[first[:-1]]
        if right:
            sa[tail[keys] - 1 - place] = j
            tail[key] -= size
        else:
            sa[head[keys] + place] = j
            head[key] += size

    put(np.array([len(t) - 1]), False)
    for c in used:
        low = starts[c]
        while low < head[c]:
            wave, low = sa[low : head[c]], head[c]
            j = wave[wave > 0] - 1
            put(j[~smaller[j]], False)
        put(seeds[at[c] : at[c + 1]] - 1, False)
    for c in reversed(used):
        high = ends[c]
        while tail[c] < high:
            wave, high = sa[tail[c] : high][::-1], tail[c]
            j = wave[wave > 0] - 1
            put(j[smaller[j]], True)
        wave = sa[starts[c] : head[c]][::-1]
        j = wave[wave > 0] - 1
        put(j[smaller[j]], True)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (whole numbers from 0) in their order; an end comes before any symbol."""
    s = np.asarray(s, np.int32)
    if len(s) < 2:
        return np.arange(len(s))
    most = int(s.max()) + 1
    if most > ALPHABET:
        base = int(np.ceil(np.sqrt(most)))
        both = _sorted_by_induction(np.stack([s // base, s % base], axis=1).ravel(), base)
        return both[both % 2 == 0] // 2
    return _sorted_by_induction(s, most)


def _named(t: np.ndarray, order: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The substrings from one leftmost-smaller position to the next by their rank, equal ones alike, in order of place."""
    n, m = len(t), len(leftmost)
    stop = np.full(n, n - 1, np.int32)
    stop[leftmost[:-1]] = leftmost[1:]
    length = stop[order] - order + 1
    final = order == leftmost[-1]
    same = np.zeros(m, bool)
    k = np.flatnonzero((length[1:] == length[:-1]) & ~final[1:] & ~final[:-1]) + 1
    if len(k):
        first = np.append(0, np.cumsum(length[k])[:-1])
        inner = np.arange(length[k].sum(), dtype=np.int32) - np.repeat(first, length[k])
        equal = t[np.repeat(order[k], length[k]) + inner] == t[np.repeat(order[k - 1], length[k]) + inner]
        same[k] = np.logical_and.reduceat(equal, first)
    names = np.empty(n, np.int32)
    names[order] = np.cumsum(~same) - 1
    return names[leftmost]


def _sorted_by_induction(s: np.ndarray, most: int) -> np.ndarray:
    """Induced sorting of a string over an alphabet of ``most`` symbols, each a bucket."""
    t = s.astype(np.uint16 if most <= 1 << 16 else np.int32)
    ends = np.cumsum(np.bincount(t, minlength=most))
    starts = np.append(0, ends[:-1])
    # A suffix is of the smaller type if its first run of one symbol is followed by a greater one.
    last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    up = np.append(t[last[:-1]] < t[last[:-1] + 1], False)
    smaller = np.repeat(up, np.diff(np.append(-1, last)))
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    del s, last, up
    if len(leftmost):
        order = _induce(t, smaller, leftmost, starts, ends)
        mark = np.zeros(len(t), bool)
        mark[leftmost] = True
        order = order[mark[order]]
        reduced = _named(t, order, leftmost)
        names = int(reduced.max()) + 1
        if names < len(leftmost):
            # Recursion must shrink the string, though names may take two digits; and short strings have too few suffixes to a bucket.
            shrinks = (1 if names <= ALPHABET else 2) * len(leftmost) <= SHRINK * len(t)
            order = leftmost[(suffix_array if shrinks and len(leftmost) > SHORT else _doubling)(reduced)]
        leftmost = order
    return _induce(t, smaller, leftmost, starts, ends)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, by its start: the symbols it shares with the one before it in the order.

    Where the symbols before both agree, the value is one less than that of the suffix one
    place earlier; the others, whose sum is small, are compared symbol by symbol, all at once.
    """
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    ended = np.append(s, -1)
    own = np.ones(n, bool)
    own[1:] = (phi[1:] <= 0) | (s[:-1] != s[phi[1:] - 1])
    at = np.flatnonzero(own)
    out = np.zeros(n, np.int64)
    a = at[phi[at] >= 0]
    b, k = phi[a], 0
    while len(a):
        going = ended[a + k] == ended[b + k]
        out[a[~going]] = k
        a, b, k = a[going], b[going], k + 1
    source = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return out[source] - (np.arange(n) - source)


def repeated(words: np.ndarray, remaining: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether the ``width`` words from each place occur at another place too, both within ``remaining``."""
    if len(words) < 2:
        return np.zeros(len(words), bool)
    sa = suffix_array(words)
    shared = common_prefixes(words, sa)[sa]
    out = np.zeros(len(words), bool)
    out[sa] = np.maximum(shared, np.append(shared[1:], 0)) >= width
    return out & (remaining >= width)


def _pieces(h: np.ndarray, text: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """The pieces of texts, whose words have the hashes ``h``: anchor hash, piece hash, first word, passages."""
    z = np.zeros(0, np.int64)
    if len(h) < width:
        return z.view(np.uint64), z.view(np.uint64), z, z
    g = texts.run_hashes(h, gram)
    span, least = 1, np.arange(len(g))
    reach = width - gram + 1

    def joined(apart: int) -> np.ndarray:
        a, b = least[: len(least) - apart], least[apart:]
        return np.where(g[a] <= g[b], a, b)

    while 2 * span <= reach:
        least = joined(span)
        span *= 2
    if span < reach:
        least = joined(reach - span)
    whole = text[width - 1 :] == text[: len(text) - width + 1]
    start = np.flatnonzero(whole)
    if not len(start):
        return z.view(np.uint64), z.view(np.uint64), z, z
    anchor = least[start]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)))
    n = np.diff(np.append(first, len(start)))
    powers, inverse = texts._tables(len(h) + 1)
    sums = np.append(np.uint64(0), np.cumsum(h * powers[: len(h)], dtype=np.uint64))
    a = start[first]
    b = a + n + width - 1
    return g[anchor[first]], texts.mix((sums[b] - sums[a]) * inverse[a] ^ n.astype(np.uint64)), a, n


def anchored(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, anchor, piece, first, n) of all pieces; ``first`` counts words."""

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts.text_array(batch.column(2))
            for lo, hi in texts.chunks(column):
                data, offsets = texts.buffers(column.slice(lo, hi - lo))
                starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
                anchor, piece, a, n = _pieces(texts.span_hashes(data, starts, ends), text, width, gram)
                if not len(a):
                    continue
                row = pa.array(text[a] + lo)
                first = a - texts.per_text(text, hi - lo)[text[a]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "text_hash", "anchor", "piece", "first", "n"])

    return docs.mapInArrow(cutter, "doc_id bigint, text_hash bigint, anchor bigint, piece bigint, first int, n int")


def _texts_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(anchor, piece, many, split, words): the words of each wanted piece, from one text that holds it."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            column = texts.text_array(batch.column(0))
            for lo, hi in texts.chunks(column):
                data, offsets = texts.buffers(column.slice(lo, hi - lo))
                starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
                begin = texts.per_text(text, hi - lo)
                rows = []
                for i in range(lo, hi):
                    for p in lists[i]:
                        w = begin[i - lo] + p["first"]
                        rows.append((p["anchor"], p["piece"], p["many"], p["split"], data[starts[w] : ends[w + p["n"] + width - 2]].tobytes()))
                columns = zip(*rows) if rows else ((),) * 5
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "piece", "many", "split", "words"])

    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "piece", "many", "split", "first", "n")).alias("pieces")).withColumnsRenamed({"doc_id": "p_id", "text_hash": "p_hash"})
    rows = docs.dropDuplicates(["doc_id", "text_hash"]).join(lists, docs["doc_id"].eqNullSafe(lists["p_id"]) & (docs["text_hash"] == lists["p_hash"]))
    return rows.select("text", "pieces").mapInArrow(fetch, "anchor bigint, piece bigint, many boolean, split boolean, words binary")


def _sorted_shard(width: int):
    def judge(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        data, offsets = texts.buffers(shard.column("words").combine_chunks().view(pa.string()))
        starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
        h = texts.span_hashes(data, starts, ends)
        word = np.unique(h, return_inverse=True)[1].astype(np.int32) + 1
        pieces = shard.num_rows
        size = np.bincount(text, minlength=pieces)
        # Zeros keep the pieces apart; a suffix is never compared beyond its own.
        stop = np.cumsum(size + 1) - 1
        s = np.zeros(len(word) + pieces, np.int32)
        place = np.arange(len(word)) + text
        s[place] = word
        remaining = np.repeat(stop, size + 1) - np.arange(len(s))
        flag = lambda name: np.repeat(shard.column(name).to_numpy(zero_copy_only=False).astype(bool), size + 1)
        again = repeated(s, remaining, width) | (flag("many") & (remaining >= width))
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        of = np.searchsorted(stop, low)
        sign = np.zeros(len(low), np.uint64)
        split = np.flatnonzero(flag("split") & (remaining >= width))
        if len(split):
            at = np.searchsorted(stop, split)
            low, high, of = np.concatenate([low, split]), np.concatenate([high, split]), np.concatenate([of, at])
            sign = np.concatenate([sign, texts.run_hashes(h, width)[split - at] | np.uint64(1)])
        base = stop[of] - size[of]
        take = lambda name: shard.column(name).take(pa.array(of))
        return pa.table({"anchor": take("anchor"), "piece": take("piece"), "low": pa.array((low - base).astype(np.int32)), "high": pa.array((high - base).astype(np.int32)), "sign": pa.array(sign.view(np.int64), mask=sign == 0)})

    return judge


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, per_shard: int = PER_SHARD) -> DataFrame:
    """(doc_id, start_word, n_words): the stretches of each text whose every word lies in a passage of
    ``width`` words that occurs elsewhere, in another text or in the same.

    Words are counted from 0. Null texts and those of fewer than ``width`` words give no row. Rows of one
    doc_id and text are one text; a null doc_id is carried. Other columns are not read.
    """
    if not 0 < gram <= width:
        raise ValueError("gram must be from 1 to width")
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    place = F.struct("doc_id", "text_hash", "first")
    same = Window.partitionBy("anchor")
    # Kept if its anchor is at two places; rows that repeat are at one.
    found = anchored(rows, width, gram).withColumns({"a": F.min(place).over(same), "b": F.max(place).over(same)}).where("a <> b").drop("a", "b")
    found = cut(found)
    one = F.struct("doc_id", "text_hash", "first", "n")
    distinct = found.groupBy("anchor", "piece").agg(F.min(one).alias("one"), (F.min(one) != F.max(one)).alias("many")).select("anchor", "piece", "many", "one.*")
    distinct = cut(distinct.withColumn("rivals", F.count("*").over(same)))
    # A piece that is all there is of its anchor occurs more than once, and all its passages with it.
    alone = distinct.where("rivals = 1").select("anchor", "piece", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
    rivals = distinct.where("rivals > 1").withColumn("split", F.col("rivals") > per_shard)
    shards = max(1, -(-rivals.count() // per_shard))
    key = F.when(F.col("split"), F.xxhash64("anchor", "piece")).otherwise(F.xxhash64("anchor"))
    held = _texts_of(rows, rivals, width).withColumn("shard", F.pmod(key, F.lit(shards)))
    judged = cut(held.groupBy("shard").applyInArrow(_sorted_shard(width), "anchor bigint, piece bigint, low int, high int, sign bigint"))
    runs = judged.where("sign IS NULL").drop("sign")
    signed = judged.where("sign IS NOT NULL")
    twice = signed.groupBy("anchor", "sign").agg(F.count("*").alias("places")).where("places > 1")
    judged = alone.unionByName(runs).unionByName(signed.join(twice, ["anchor", "sign"], "left_semi").drop("sign"))
    hits = found.join(judged, ["anchor", "piece"]).select("doc_id", "text_hash", (F.col("first") + F.col("low")).alias("a"), (F.col("first") + F.col("high") + width - 1).alias("b")).distinct()
    by_text = Window.partitionBy("doc_id", "text_hash").orderBy("a", "b")
    before = hits.withColumn("before", F.max("b").over(by_text.rowsBetween(Window.unboundedPreceding, -1)))
    merged = before.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("a") > F.col("before") + 1), 1).otherwise(0)).over(by_text))
    return merged.groupBy("doc_id", "text_hash", "island").agg(F.min("a").cast("bigint").alias("start_word"), (F.max("b") - F.min("a") + 1).cast("bigint").alias("n_words")).select("doc_id", "start_word", "n_words")


def oracle(width: int = WIDTH) -> str:
    squeeze = r"trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))"
    return f"""
    WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, hash(text) AS h, string_split({squeeze}, ' ') AS w FROM d),
    p AS MATERIALIZED (SELECT doc_id, h, i, array_to_string(w[i + 1 : i + {width}], ' ') AS passage
          FROM (SELECT doc_id, h, w, unnest(range(0, len(w) - {width} + 1)) AS i FROM w WHERE len(w) >= {width})),
    r AS (SELECT passage FROM p GROUP BY passage HAVING count(*) > 1),
    s AS (SELECT doc_id, h, i, max(i) OVER (PARTITION BY doc_id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p JOIN r USING (passage)),
    g AS (SELECT doc_id, h, i, sum(CASE WHEN before IS NULL OR i > before + {width} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, h ORDER BY i) AS island FROM s)
    SELECT doc_id, min(i) AS start_word, max(i) - min(i) + {width} AS n_words FROM g GROUP BY doc_id, h, island"""
