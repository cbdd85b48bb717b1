"""Token counts of a byte-level BPE vocabulary, by merging many pre-tokens in step.

Texts are cut into pre-tokens by the classes of their characters, a whole batch at once. A batch of
distinct pre-tokens is one flat array of symbols, each with the pre-token it belongs to. In
every round each pre-token's lowest-rank pair is found and all its occurrences (from the
left, without overlap) are merged at once; pre-tokens without a pair drop out. The symbols
that survive are the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What ``pretokens`` cuts a text into, as the vocabulary's own rule.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose count a worker remembers; at this many it forgets them all and starts again.
REMEMBERED = 300_000
#: Bytes of text that are handled at once.
AT_ONCE = 1 << 20
_NONE = np.int64(1) << np.int64(40)


class Merger:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        # An open-addressing table: a pair's slot is its hash, or one of the next.
        self.bits = max(4, (len(keys) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.bits) + 64, _NONE, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], slot[~put] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(texts._P)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, _NONE where there is none."""
        key = left << 20 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            found = self.keys[slot[open_] + k]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]] + k]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merged(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pre-tokens that lie one after another in ``data``, and how many each has."""
        size_of = np.zeros(len(length), np.int64)
        symbol = self.byte[data]
        word = np.repeat(np.arange(len(length)), length)
        done = [(np.zeros(0, np.int64), symbol[:0])]
        rank = np.full(len(symbol), _NONE)  # of the pair that begins at each symbol
        if len(symbol) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank(symbol[:-1], symbol[1:]), _NONE)
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            going = least < _NONE
            if not going.all():
                size_of[word[starts[~going]]] = size[~going]
                stay = np.repeat(going, size)
                done.append((word[~stay], symbol[~stay]))
                symbol, word, rank = symbol[stay], word[stay], rank[stay]
                if not len(symbol):
                    break
                least, size = least[going], size[going]
            hit = rank == np.repeat(least, size)
            # In a run of such pairs every second one overlaps the one before it.
            at = np.flatnonzero(hit)
            run_start = np.append(True, (np.diff(at) != 1))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbol[at] = rank[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, word, rank, changed = symbol[keep], word[keep], rank[keep], changed[keep]
            # Pairs that begin at a merged symbol or just before one have new ranks.
            again = changed.copy()
            again[:-1] |= changed[1:]
            again = np.flatnonzero(again)
            inner = again[again < len(symbol) - 1]
            rank[again] = _NONE
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        word, symbol = (np.concatenate(x) for x in zip(*done))
        return symbol[np.argsort(word, kind="stable")].astype(np.int32), size_of


LETTER, NUMBER, SPACE, OTHER = range(4)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point, by the pattern's own character classes; made once for a worker."""
    if not _CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for class_, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = class_
        _CLASSES.append(out)
    return _CLASSES[0]


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    of = _classes()
    out = of[:256][data]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = wide[data[wide] >= 0xC0]
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        ended = np.append(data, np.zeros(3, np.uint8))
        for k in (1, 2, 3):
            code = np.where(size > k, code << 6 | ended[lead + k] & 0x3F, code)
        class_ = of[code]
        for k in range(4):
            inside = size > k
            out[lead[inside] + k] = class_[inside]
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all pre-tokens of texts of UTF-8 bytes, as PATTERN finds them.

    A run of letters, of numbers or of other characters takes a blank before it along; of a run of white space
    before one the last character stands alone unless it is such a blank. A lone apostrophe
    without a blank before it begins a contraction, if the letters after it begin with one.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    class_ = _byte_classes(data)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    run = np.ones(n + 1, bool)
    run[1:n] = class_[1:] != class_[:-1]
    run |= text_start
    first = np.flatnonzero(run[:n])  # of every run
    stop = np.append(first[1:], n)
    kind = class_[first]
    edge = run.copy()
    blank = np.zeros(n + 1, bool)  # a run takes along the blank that ends before its first byte
    follows = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[first[1:]])
    begin = first[follows + 1]
    # The last character of the white space: back to the byte that leads it.
    last = begin - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    edge[last] = True
    taken = data[last] == 32
    edge[begin[taken]] = False
    blank[begin[taken]] = True
    # Contractions.
    lone = (kind == OTHER) & (data[first] == 39) & (stop - first == 1) & ~blank[first]
    k = np.flatnonzero(lone[:-1] & (kind[1:] == LETTER) & ~text_start[first[1:]])
    if len(k):
        ended = np.append(data, np.zeros(1, np.uint8))
        a, size = ended[first[k + 1]], stop[k + 1] - first[k + 1]
        b = np.where(size > 1, ended[np.minimum(first[k + 1] + 1, n)], 0)
        pair = a.astype(np.int32) << 8 | b
        two = np.isin(pair, [ord("l") << 8 | ord("l"), ord("v") << 8 | ord("e"), ord("r") << 8 | ord("e")])
        one = np.isin(a, [ord(c) for c in "sdmt"])
        some = one | two
        edge[first[k + 1][some]] = False
        edge[first[k + 1][some] + np.where(one, 1, 2)[some]] = True
    starts = np.flatnonzero(edge[:n])
    return starts, np.append(starts[1:], n)


class Tokenizer:
    """Tokens of texts; it remembers those of the pre-tokens it has seen (all are forgotten at REMEMBERED)."""

    def __init__(self, path: str = VOCABULARY):
        self.merger = Merger(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.known) + len(h) > REMEMBERED:
            self._forget()
        length = ends - starts
        flat = np.repeat(starts - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        ids, size = self.merger.merged(data[flat], length)
        if self.used + len(ids) > len(self.store):
            self.store = np.append(self.store[: self.used], np.zeros(self.used + 2 * len(ids), np.int32))
        self.store[self.used : self.used + len(ids)] = ids
        to = np.searchsorted(self.known, h)
        at = self.used + np.append(0, np.cumsum(size)[:-1])
        self.known, self.at, self.size = (np.insert(x, to, y) for x, y in ((self.known, h), (self.at, at), (self.size, size)))
        self.used += len(ids)

    def _looked_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token of the texts is remembered, and where each text's pre-tokens begin."""
        starts, ends = pretokens(data, offsets)
        h, first, which = np.unique(texts.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            self._learn(h[new], data, starts[first[new]], ends[first[new]])
        return np.searchsorted(self.known, h)[which], np.searchsorted(starts, offsets)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of each text; -1 for null."""
        column = texts.text_array(column)
        n_tokens, n_words = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for a, b in texts.chunks(column, AT_ONCE):
            data, offsets = texts.buffers(column.slice(a, b - a))
            at, bounds = self._looked_up(data, offsets)
            n_tokens[a:b], n_words[a:b] = texts.sums_by(self.size[at], bounds), np.diff(bounds)
        null = column.is_null().to_numpy(zero_copy_only=False)
        n_tokens[null] = n_words[null] = -1
        return n_tokens, n_words

    def tokens(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, tokens, where each text's tokens begin) of successive texts; a null has none."""
        column = texts.text_array(column)
        for a, b in texts.chunks(column, AT_ONCE):
            data, offsets = texts.buffers(column.slice(a, b - a))
            at, bounds = self._looked_up(data, offsets)
            size = self.size[at]
            ends = np.append(0, np.cumsum(size))
            flat = np.repeat(self.at[at] - ends[:-1], size) + np.arange(ends[-1])
            yield a, b, self.store[flat], ends[bounds]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    """One for a worker, whatever tasks it gets."""
    if vocabulary not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[vocabulary] = Tokenizer(vocabulary)
    return _tokenizers[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row of ``docs``.

    A null text has null counts, an empty one 0. Rows that repeat are counted each; a null
    doc_id is carried, a text of any length is counted whole, an empty table gives no row. Only doc_id and text are
    read, whatever other columns there are. ``vocabulary`` is the path of a rank file that every machine can read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = tokenizer(vocabulary).counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, mask=n < 0), pa.array(k, mask=k < 0)], names=["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, n_tokens bigint, n_pretokens bigint")
