"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm over
its bytes; a text's log-probability is the sum over its words. Pieces' probabilities are
fitted by expectation-maximisation on texts of known language. Single bytes are pieces too, so
every word has a segmentation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most texts a language's probabilities are fitted on: those of least hash, each as a whole.
SAMPLE = 250
ROUNDS, SMOOTHING = 3, 0.1
CHUNK = 4 << 20
REMEMBERED = 1_000_000
#: Longer words are scored and trained on in logarithms.
LONG = 40


class Pieces:
    """The vocabulary as a hashed trie: all prefixes of all pieces, with the piece id where one ends."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                p = piece.replace("▁", " ").encode()
                if b" " not in p[1:]:
                    found.add(p)
        self.pieces = sorted(found)
        self.longest = max(map(len, self.pieces))
        prefixes = {p[:k]: -1 for p in self.pieces for k in range(1, len(p) + 1)} | {p: i for i, p in enumerate(self.pieces)}
        by_length = sorted(prefixes, key=len)
        length = np.array([len(p) for p in by_length])
        ends = np.cumsum(length)
        keys = texts.span_hashes(np.frombuffer(b"".join(by_length), np.uint8), ends - length, ends)
        self.bits = (len(keys) * 4).bit_length()
        self.keys = np.zeros((1 << self.bits) + 64, np.uint64)
        self.ids = np.full((1 << self.bits) + 64, -2, np.int32)
        ids = np.array([prefixes[p] for p in by_length], np.int32)
        slot, self.probes = (keys >> np.uint64(64 - self.bits)).astype(np.int64), 0
        while len(keys):
            self.probes += 1
            put = self.ids[slot] == -2
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put &= first
            self.keys[slot[put]], self.ids[slot[put]] = keys[put], ids[put]
            keys, ids, slot = keys[~put], ids[~put], slot[~put] + 1

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a prefix that is no piece, -2 for neither."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -2, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = self.ids[slot[hit]]
            go = ~hit & (self.ids[slot] != -2)
            todo, slot = todo[go], slot[go] + 1
            if not len(todo):
                break
        return out

    def edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of every piece within every word, by bytes of ``data``."""
        powers, inverse = texts._tables(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        length = ends - starts
        at = np.repeat(starts - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        stop = np.repeat(ends, length)
        a, b, piece = [], [], []
        for n in range(1, self.longest + 1):
            inside = at + n <= stop
            at, stop = at[inside], stop[inside]
            if not len(at):
                break
            ids = self.lookup(texts.mix((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n)))
            there = ids >= 0
            a.append(at[there])
            b.append(at[there] + n)
            piece.append(ids[there])
            on = ids > -2
            at, stop = at[on], stop[on]
        z = np.zeros(0, np.int64)
        return (np.concatenate(x) if x else z for x in (a, b, piece))


def _layout(words_start: np.ndarray, words_end: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in order of their start within the word; where each start's edges begin."""
    word = np.searchsorted(words_start, a, "right") - 1
    rel = a - words_start[word]
    order = np.argsort(rel, kind="stable")
    most = int((words_end - words_start).max()) if len(words_start) else 0
    return order, np.searchsorted(rel[order], np.arange(most + 1))


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words copied one after another, each after a blank (a piece's mark of a word's beginning) and before a spare byte."""
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = ends - starts + 2
    s = np.append(0, np.cumsum(length)[:-1])
    out = np.zeros(int(length.sum()), np.uint8)
    inner = np.repeat(starts - s - 1, length - 2)
    to = np.repeat(s + 1 - np.append(0, np.cumsum(length - 2)[:-1]), length - 2) + np.arange((length - 2).sum())
    out[to] = data[inner + to]
    out[s] = 32
    return out, s, s + length - 1


def log_probabilities(pieces: Pieces, logp: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-probability of every word in every language; ``logp`` is (pieces, languages)."""
    out = np.zeros((len(starts), logp.shape[1]))
    long = ends - starts > LONG
    for which, logs in ((~long, False), (long, True)):
        at = np.flatnonzero(which)
        if not len(at):
            continue
        d, s, e = padded(data, starts[at], ends[at])
        a, b, piece = pieces.edges(d, s, e)
        order, bounds = _layout(s, e, a)
        a, b, piece = a[order], b[order], piece[order]
        if logs:
            alpha = np.full((len(d) + 1, logp.shape[1]), -np.inf)
            alpha[s] = 0
            for k in range(len(bounds) - 1):
                i = slice(bounds[k], bounds[k + 1])
                alpha[b[i]] = np.logaddexp(alpha[b[i]], alpha[a[i]] + logp[piece[i]])
            out[at] = alpha[e]
        else:
            # Each byte's share of a usual word's probability is taken out, so that long words don't underflow.
            usual = 4.0
            p = np.exp(logp[piece] + usual * (b - a)[:, None])
            alpha = np.zeros((len(d) + 1, logp.shape[1]))
            alpha[s] = 1
            for k in range(len(bounds) - 1):
                i = slice(bounds[k], bounds[k + 1])
                alpha[b[i]] += alpha[a[i]] * p[i]
            out[at] = np.log(alpha[e]) - usual * (e - s)[:, None]
    return out


def _expected(at: tuple, logp: np.ndarray, logs: bool) -> np.ndarray:
    """How often each piece is used in the words of ``at``, by forward and backward sums."""
    n, s, e, a, b, piece, bounds, word, count = at
    if logs:
        p = logp[piece]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[s], beta[e] = 0, 0
    else:
        p = np.exp(logp[piece] + 4.0 * (b - a))
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        alpha[s], beta[e] = 1, 1
    for k in range(len(bounds) - 1):
        i = slice(bounds[k], bounds[k + 1])
        alpha[b[i]] = np.logaddexp(alpha[b[i]], alpha[a[i]] + p[i]) if logs else alpha[b[i]] + alpha[a[i]] * p[i]
    for k in reversed(range(len(bounds) - 1)):
        i = slice(bounds[k], bounds[k + 1])
        if logs:
            np.logaddexp.at(beta, a[i], beta[b[i]] + p[i])
        else:
            np.add.at(beta, a[i], beta[b[i]] * p[i])
    used = np.exp(alpha[a] + p + beta[b] - alpha[e[word]]) if logs else alpha[a] * p * beta[b] / np.maximum(alpha[e[word]], 1e-300)
    return np.bincount(piece, used * count[word], len(logp))


def fit(pieces: Pieces, words: dict[str, dict[bytes, int]], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-probabilities (pieces, languages) from counted words of each language, by EM."""
    out = []
    for language in sorted(words):
        groups = []
        for logs in (False, True):
            kept = [w for w in sorted(words[language]) if (len(w) > LONG) == logs]
            if not kept:
                continue
            length = np.array([len(w) for w in kept], np.int64)
            ends = np.cumsum(length)
            d, s, e = padded(np.frombuffer(b"".join(kept), np.uint8), ends - length, ends)
            a, b, piece = pieces.edges(d, s, e)
            order, bounds = _layout(s, e, a)
            a, b, piece = a[order], b[order], piece[order]
            word = np.searchsorted(s, a, "right") - 1
            groups.append(((len(d), s, e, a, b, piece, bounds, word, np.array([words[language][w] for w in kept], float)), logs))
        logp = np.full(len(pieces.pieces), -np.log(len(pieces.pieces)))
        for _ in range(rounds):
            total = sum(_expected(at, logp, logs) for at, logs in groups) + smoothing
            logp = np.log(total / total.sum())
        out.append(logp)
    return np.stack(out, axis=1)


def train(docs: DataFrame, sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) from at most ``sample`` texts of each value of ``lang``; rows without one are passed over."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", F.col("doc_id").cast("bigint").alias("id"))
    # Bounded by ``sample`` ids for each language, so broadcasting them doesn't grow with the corpus.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = labelled.withColumn("rank", rank).where(F.col("rank") <= sample).select(F.col("lang").alias("__lang"), F.col("id").alias("__id"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("lang").alias("__of"), "text")
    texts_ = own.join(F.broadcast(chosen), (F.col("__doc") == F.col("__id")) & (F.col("__of") == F.col("__lang"))).select("__lang", F.explode(F.split("text", r"[ \t\n\f\r]+")).alias("__word"))
    # The driver gets the distinct words of the sampled texts, however long those are.
    words: dict[str, dict[bytes, int]] = {}
    for r in texts_.where("__word <> ''").groupBy("__lang", "__word").agg(F.count("*").alias("n")).toLocalIterator():
        words.setdefault(r["__lang"], {})[r["__word"].encode()] = r["n"]
    return sorted(words), fit(Pieces(vocabulary), words) if words else np.zeros((0, 0))


class Scorer:
    """Scores texts, and remembers the words it has scored (all are forgotten at REMEMBERED)."""

    def __init__(self, logp: np.ndarray, vocabulary: str = VOCABULARY):
        self.pieces, self.logp = Pieces(vocabulary), logp
        self._forget()

    def _forget(self) -> None:
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, self.logp.shape[1]))

    def _words(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probabilities of words of distinct, ascending hashes."""
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        out = np.empty((len(h), self.logp.shape[1]))
        out[~new] = self.scores[at[~new]]
        if new.any():
            out[new] = log_probabilities(self.pieces, self.logp, data, starts[new], ends[new])
            if len(self.known) + new.sum() > REMEMBERED:
                self._forget()
            if new.sum() <= REMEMBERED:
                to = np.searchsorted(self.known, h[new])
                self.known, self.scores = np.insert(self.known, to, h[new]), np.insert(self.scores, to, out[new], axis=0)
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (texts, languages), and bytes of all words of each text."""
        column = texts.text_array(column)
        scores, size = np.zeros((len(column), self.logp.shape[1])), np.zeros(len(column))
        for a, b in texts.chunks(column, CHUNK):
            data, offsets = texts.buffers(column.slice(a, b - a))
            starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
            if not len(starts):
                continue
            h, first, which = np.unique(texts.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            logp = self._words(h, data, starts[first], ends[first])
            bounds = texts.per_text(text, b - a)
            for k in range(logp.shape[1]):
                scores[a:b, k] = texts.sums_by(logp[which, k], bounds)
            size[a:b] = texts.sums_by(ends - starts, bounds)
        return scores, size


_scorers: dict[tuple, Scorer] = {}


def _scorer(logp: np.ndarray, vocabulary: str) -> Scorer:
    """One for a worker, whatever tasks it gets."""
    key = (vocabulary, logp.shape, logp.tobytes())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(logp, vocabulary)
    return _scorers[key]


def identified(docs: DataFrame, languages: list[str], logp: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, language, margin) for each row: the likeliest language, and by how many nats a byte it leads.

    A null text, or one without words, has language null and margin 0. If languages tie the
    first in the alphabet is named. Rows that repeat are scored each; a null doc_id is
    carried. Only doc_id and text are read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or _scorer(logp, vocabulary)
            scores, size = scorer(batch.column(1))
            best = scores.argmax(axis=1)
            top = np.sort(scores, axis=1)
            margin = (top[:, -1] - top[:, -2]) / np.maximum(size, 1) if scores.shape[1] > 1 else np.zeros(len(size))
            names = pa.array(np.array(languages, object)[best], pa.string(), mask=size == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(np.where(size > 0, margin, 0.0))], names=["doc_id", "language", "margin"])

    chosen = docs.select(F.col("doc_id").cast("bigint"), "text")
    if not languages:
        return chosen.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("margin"))
    return chosen.mapInArrow(score, "doc_id bigint, language string, margin double")
