"""Toxic spans by a linear-chain conditional random field.

A token (a run of word bytes, Latin capitals in lower case) has hashed features: the word, its first
3 to 6 bytes, and its neighbours. Two states, clean and toxic, are chained by learned
transitions. Labels are of documents; tokens of toxic documents are labelled by the features that
labelled documents show to be toxic (smoothed purity). The forward-backward algorithm gives
each token's marginal; the sum of high ones is the document's score, their runs are its spans. A document is
reported for its sum, or for one token of very high marginal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts
from .quality import _labelled

#: Most labelled documents that the field is fitted on, those of least hash.
SAMPLE = 2000
BITS = 18
PREFIXES = (3, 4, 5, 6)
#: A feature is toxic from this share of its rate, if so many toxic documents have it, and such a share of them.
PURITY, SUPPORT, SUPPORT_SHARE = 0.95, 4, 0.02
CHAIN = 512
ROUNDS, RATE, DECAY = 40, 0.5, 1e-3
#: A token is in a span from this marginal; a document is reported from this sum of such tokens' marginals
#: (the slight marginals of a long text's many clean tokens would add up otherwise).
LEAST_TOKENS, LEAST_MARGINAL = 1.5, 0.5
#: One token alone is enough from this marginal.
SURE_MARGINAL = 0.98
CHUNK = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8, byte for byte, so that offsets stay."""
    out = _LOWER[data]
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 0x20
    return out


def _tokens(column: pa.Array):
    """Bytes in lower case, offsets, and tokens: starts, ends, text of each, hash of each."""
    data, offsets = texts.buffers(column)
    data = lowered(data)
    starts, ends, text = texts.spans(data, offsets, texts.IS_WORD)
    return data, offsets, starts, ends, text, texts.span_hashes(data, starts, ends)


def _own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Slots of a word's own features: the word, and each prefix (the word again if it is shorter)."""
    columns = [texts.mix(h + np.uint64(1))]
    for k in PREFIXES:
        p = texts.span_hashes(data, starts, np.minimum(ends, starts + k))
        columns.append(np.where(ends - starts >= k, texts.mix(p + np.uint64(100 + k)), columns[0]))
    return (np.stack(columns, axis=1) >> np.uint64(64 - BITS)).astype(np.int64)


def _near_features(h: np.ndarray) -> np.ndarray:
    """Slots of a word as the one before, and as the one after."""
    return (np.stack([texts.mix(h + np.uint64(2)), texts.mix(h + np.uint64(3))], axis=1) >> np.uint64(64 - BITS)).astype(np.int64)


def _chain(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds messages of the two-state chain: forward (own emission in it) and backward, for every token.

    All texts move on together: step t handles the t-th token of every text that has one.
    """
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    first, size = bounds[:-1][order], length[order]
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, most + 1), "right")
    forward, backward = emission.copy(), np.zeros(len(emission))
    (t00, t01), (t10, t11) = np.exp(transition)
    r = np.zeros(0)
    for t in range(most):
        k = active[t]
        at = first[:k] + t
        if t:
            x = np.exp(np.clip(r[:k], -50, 50))
            r = emission[at] + np.log((t01 + t11 * x) / (t00 + t10 * x))
        else:
            r = emission[at].copy()
        forward[at] = r
    r = np.zeros(len(size))
    for t in range(most - 2, -1, -1):
        k = active[t + 1]
        at = first[:k] + t
        x = np.exp(np.clip(r[:k] + emission[at + 1], -50, 50))
        r[:k] = np.log((t10 + t11 * x) / (t00 + t01 * x))
        backward[at] = r[:k]
    return forward, backward


def marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability that each token is toxic; the texts' tokens lie between ``bounds``."""
    forward, backward = _chain(emission, bounds, transition)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))


def _pair_marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token marginals, and the expected number of each transition over all texts."""
    forward, backward = _chain(emission, bounds, transition)
    one = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
    inner = np.ones(len(emission), bool)
    inner[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False
    a = np.flatnonzero(inner)
    f, g = np.clip(forward[a], -50, 50), np.clip(emission[a + 1] + backward[a + 1], -50, 50)
    w = np.exp(transition)[None] * np.exp(np.stack([np.zeros_like(f), f], 1))[:, :, None] * np.exp(np.stack([np.zeros_like(g), g], 1))[:, None, :]
    w /= w.sum(axis=(1, 2), keepdims=True)
    return one, w.sum(axis=0)


class Field:
    def __init__(self, weights: np.ndarray, bias: float, transition: np.ndarray):
        self.weights, self.bias, self.transition = weights, bias, transition

    def emission(self, data, starts, ends, text, h) -> np.ndarray:
        """Log-odds of each token by its features; every distinct word's are summed once."""
        u, first, which = np.unique(h, return_index=True, return_inverse=True)
        return self.by_words(_own_features(data, starts[first], ends[first], u), _near_features(u), which, np.flatnonzero(text[1:] == text[:-1]))

    def by_words(self, own: np.ndarray, near: np.ndarray, which: np.ndarray, inner: np.ndarray) -> np.ndarray:
        out = self.weights[own].sum(axis=1)[which] + self.bias
        w = self.weights[near]
        out[inner + 1] += w[which[inner], 0]
        out[inner] += w[which[inner + 1], 1]
        return out


def fit(column: pa.Array, toxic: np.ndarray, rounds: int = ROUNDS) -> Field:
    """A field for texts labelled 0 or 1 as a whole, by gradient ascent on the tokens' log-likelihood."""
    data, _, starts, ends, text, h = _tokens(column)
    n = len(column)
    weights, bias, transition = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    if not len(starts) or not np.any(toxic == 1):
        return Field(weights, -20.0, transition)
    u, first, which = np.unique(h, return_index=True, return_inverse=True)
    own, near = _own_features(data, starts[first], ends[first], u), _near_features(u)
    # Purity of each feature by tokens: its rate in toxic documents against that in clean ones. Equal documents count once.
    once = np.zeros(n, bool)
    whole = texts.sums_by(h.view(np.int64).astype(float) % 1e9, texts.per_text(text, n))
    once[np.unique(np.stack([whole, np.diff(texts.per_text(text, n))]), axis=1, return_index=True)[1]] = True
    used = once[text]
    sides = [used & (toxic[text] == k) for k in (0, 1)]
    counts_of, documents = np.zeros((2, 1 << BITS)), np.zeros(1 << BITS)
    for k in range(own.shape[1]):
        slot = own[which, k]
        new = np.ones(1, bool) if k == 0 else (own[:, :k] != own[:, [k]]).all(axis=1)[which]
        for side in (0, 1):
            counts_of[side] += np.bincount(slot[sides[side] & new], minlength=1 << BITS)
        pair = np.unique(text[sides[1] & new].astype(np.int64) << BITS | slot[sides[1] & new])
        documents += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
    rate = (counts_of + [[1.0], [0.0]]) / np.maximum([[sides[0].sum()], [sides[1].sum()]], 1)
    least = max(SUPPORT, SUPPORT_SHARE * (once & (toxic == 1)).sum())
    pure = (documents >= least) & (rate[1] / (rate[0] + rate[1] + 1e-300) >= PURITY)
    y = (pure[own].any(axis=1)[which] & (toxic[text] == 1)).astype(float)
    # Long texts are several chains in training, so that all have similar lengths.
    begin = texts.per_text(text, n)
    bounds = np.unique(np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(begin[:-1], begin[1:])] + [[len(text)]])).astype(np.int64)
    inner = np.setdiff1d(np.arange(len(text) - 1), bounds[1:-1] - 1)
    before, after = which[inner], which[inner + 1]
    counts = np.zeros((2, 2))
    np.add.at(counts, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
    sum_w, sum_b, sum_t = np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        e = Field(weights, bias, transition).by_words(own, near, which, inner)
        p, expected = _pair_marginals(e, bounds, transition)
        d = y - p
        g = np.zeros(1 << BITS)
        of_word = np.bincount(which, d, len(u))
        for k in range(own.shape[1]):
            g += np.bincount(own[:, k], of_word, 1 << BITS)
        g += np.bincount(near[:, 0], np.bincount(before, d[inner + 1], len(u)), 1 << BITS)
        g += np.bincount(near[:, 1], np.bincount(after, d[inner], len(u)), 1 << BITS)
        g -= DECAY * len(y) / 1000 * weights
        gt = counts - expected
        sum_w += g * g
        sum_b += d.sum() ** 2
        sum_t += gt * gt
        weights += RATE * g / np.sqrt(sum_w)
        bias += RATE * d.sum() / np.sqrt(sum_b)
        transition += RATE * gt / np.sqrt(sum_t)
    return Field(weights, float(bias), transition)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most ``sample`` labelled documents."""
    rows = _labelled(docs, labels, "toxic", sample).toPandas().sort_values(["__id", "text"], kind="stable")
    return fit(pa.array(rows["text"], pa.string()), rows["y"].to_numpy(int))


def _found(column: pa.Array, field: Field, least_tokens: float, least_marginal: float) -> Iterator[tuple[int, float, list[int], list[int]]]:
    column = texts.text_array(column)
    for a, b in texts.chunks(column, CHUNK):
        data, offsets, starts, ends, text, h = _tokens(column.slice(a, b - a))
        if not len(starts):
            continue
        bounds = texts.per_text(text, b - a)
        p = marginals(field.emission(data, starts, ends, text, h), bounds, field.transition)
        expected = texts.sums_by(np.where(p >= least_marginal, p, 0.0), bounds)
        sure = texts.sums_by((p >= SURE_MARGINAL).astype(float), bounds) > 0
        for i in np.flatnonzero((expected >= least_tokens) | sure).tolist():
            hot = np.flatnonzero(p[bounds[i] : bounds[i + 1]] >= least_marginal)
            cuts = np.flatnonzero(np.diff(hot) > 1)
            lo, hi = hot[np.append(0, cuts + 1)] if len(hot) else hot, hot[np.append(cuts, len(hot) - 1)] if len(hot) else hot
            # Offsets in characters: bytes that begin one, counted from the text's beginning.
            chars = np.append(0, np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80))
            s, e = starts[bounds[i] + lo] - offsets[i], ends[bounds[i] + hi] - offsets[i]
            yield a + i, float(expected[i]), chars[s].tolist(), chars[e].tolist()


def toxic_spans(docs: DataFrame, field: Field, least_tokens: float = LEAST_TOKENS, least_marginal: float = LEAST_MARGINAL) -> DataFrame:
    """(doc_id, toxicity, span_starts, span_ends) of the toxic documents: the sum of
    high marginals, and the spans' character offsets (end exclusive).

    Clean documents, null and empty texts give no row. Rows that repeat are tagged each; a
    null doc_id is carried. Only doc_id and text are read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(field.weights.astype(np.float32))
    bias, transition = field.bias, field.transition

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(weights.value, bias, transition)
        for batch in batches:
            found = [*_found(batch.column(1), f, least_tokens, least_marginal)]
            rows, score, s, e = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(score, pa.float64()), pa.array(s, pa.list_(pa.int32())), pa.array(e, pa.list_(pa.int32()))], names=["doc_id", "toxicity", "span_starts", "span_ends"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tag, "doc_id bigint, toxicity double, span_starts array<int>, span_ends array<int>")
