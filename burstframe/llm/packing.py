"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents become tokens of a public vocabulary, with a mark of the end after each. Those longer than the
largest length are cut into pieces of it. Pieces are dealt to shards of a bounded size by a hash of
their row and place; every shard is packed on its own, longest piece first: a piece goes to the open bin that it fills best (least room left, the oldest
at a tie). If none has room, a bin of the size with the least cost is opened, counting
``cost(size)`` against the tokens that can still come into it, and in the end every bin
shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts
from .tokens import VOCABULARY, tokenizer

SIZES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence: a fixed part, a part for each token, and attention's part for each pair of tokens.
FIXED, PER_PAIR = 64.0, 1 / 32768
#: Bytes of text that a shard is made of on average; a document counts DOCUMENT of them besides, so that many short ones are no larger shard.
PER_SHARD, DOCUMENT = 6 << 20, 1024
#: The id that the vocabulary leaves free ends a document.
END = 50_256
SCHEMA = "shard bigint, bin bigint, size int, n_tokens int, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, lengths array<int>, tokens array<int>"


def cost(size: int) -> float:
    return FIXED + size + size * size * PER_PAIR


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[list[int], list[int]]:
    """Bin of each piece, size of each bin. ``lengths`` are in the order of packing, at most max(sizes) each."""
    sizes = sorted(set(sizes))
    price = {s: cost(s) for s in sizes}
    room: dict[int, list[int]] = {}  # space left: bins with it, the oldest first
    rooms: list[int] = []  # its keys in order
    left: list[int] = []
    opened: list[int] = []
    bins = []
    to_come = int(sum(lengths))
    for n in lengths:
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            r = rooms[k]
            b = heapq.heappop(room[r])
            if not room[r]:
                del room[r], rooms[k]
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (price[s] / min(s, to_come), s))
            b = len(left)
            left.append(size)
            opened.append(size)
        to_come -= n
        left[b] -= n
        bins.append(b)
        if r := left[b]:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            heapq.heappush(room[r], b)
    return bins, [next(s for s in sizes if s >= size - r) for size, r in zip(opened, left)]


def _listed(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def pieces(batch: pa.RecordBatch, largest: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, piece, start, tokens) of a batch of (row, doc_id, text), no piece longer than ``largest``."""
    column = texts.text_array(batch.column(2))
    null = column.is_null().to_numpy(zero_copy_only=False)
    for a, b, tokens, bounds in tokenizer(vocabulary).tokens(column):
        there = np.flatnonzero(~null[a:b])
        flat = np.insert(tokens, bounds[1:][there], END)
        n = np.diff(bounds)[there] + 1
        begin = np.append(0, np.cumsum(n)[:-1])
        many = -(-n // largest)
        of = np.repeat(np.arange(len(there)), many)
        piece = np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(many)[:-1]), many)
        row = pa.array(a + there[of])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(piece.astype(np.int32)), pa.array(piece * largest), _listed(np.append(begin[of] + piece * largest, len(flat)), pa.array(flat))], names=["row", "doc_id", "piece", "start", "tokens"])


def _pack(sizes: Sequence[int]):
    def pack(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        lists = shard.column("tokens").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = shard.column("doc_id").combine_chunks()
        # Longest first; of equals the lesser id, null last.
        order = np.lexsort((shard.column("row").to_numpy(), shard.column("piece").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -n))
        bins, size = best_fit(n[order].tolist(), sizes)
        grouped = order[np.argsort(bins, kind="stable")]
        at = np.append(0, np.cumsum(np.bincount(bins, minlength=len(size))))
        ends = np.append(0, np.cumsum(n[grouped]))
        take = lambda name: _listed(at, shard.column(name).take(pa.array(grouped)).combine_chunks())
        columns = [
            pa.array(np.full(len(size), key[0].as_py())), pa.array(np.arange(len(size))), pa.array(size, pa.int32()), pa.array(np.diff(ends[at]).astype(np.int32)),
            take("doc_id"), take("piece"), take("start"), _listed(at, pa.array(n[grouped].astype(np.int32))), _listed(ends[at], lists.take(pa.array(grouped)).flatten()),
        ]
        del lists, shard
        texts.give_back()
        return pa.Table.from_arrays(columns, names=["shard", "bin", "size", "n_tokens", "doc_ids", "pieces", "starts", "lengths", "tokens"])

    return pack


def pack(docs: DataFrame, sizes: Sequence[int] = SIZES, vocabulary: str = VOCABULARY, per_shard: int = PER_SHARD) -> DataFrame:
    """A row for each training sequence: shard, bin, size, n_tokens (at most size), tokens, and of each
    piece in it, in order, doc_ids, pieces (numbered within the document), starts (in its tokens) and lengths.

    A null text gives no piece; an empty one is a piece of one token, the mark of the end. Rows that repeat are
    packed each; a null doc_id is packed as null; an empty table gives no sequence; a text of any length is cut
    into as many pieces as it needs. Only doc_id and text are read. ``docs`` should be a stored table, whose rows
    a repeated task reads in the same order.
    """
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes must be positive")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # A token is a byte at least, so bytes bound the tokens of a shard before any is made.
    weight = docs.agg(F.sum(F.octet_length("text") + DOCUMENT)).first()[0] or 0
    shards = max(1, -(-weight // per_shard))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch, sizes[-1], vocabulary)
        texts.give_back()

    every = rows.mapInArrow(cut_up, "row bigint, doc_id bigint, piece int, start bigint, tokens array<int>")
    return every.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards))).groupBy("shard").applyInArrow(_pack(sizes), SCHEMA)
