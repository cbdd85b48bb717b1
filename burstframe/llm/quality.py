"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics with logistic loss. Chosen statistics
have a direction: a split that would let the score move against it is refused, and the
children's values are bounded by the split's middle so that no later split breaks it. The trees are
flattened into node arrays; scoring moves all rows through all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

#: Statistics, and the direction in which each may move the score (0: either).
STATISTICS = {
    "log_words": 0, "word_length": 0, "upper": -1, "digits": 0, "symbols": -1, "marks": -1, "spaces": 0, "lines": 0,
    "repeats": -1, "distinct_words": 0, "distinct_trigrams": 1, "top_word": -1, "bars": -1, "symbol_words": -1, "shouted": -1, "short_words": 0,
}
#: Most labelled rows that the trees are fitted on, those of least hash.
SAMPLE = 6000
TREES, DEPTH, BINS, RATE, SMOOTHING, LEAST_ROWS = 60, 4, 32, 0.2, 1.0, 8
THRESHOLD = 0.5

_UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _LINE = (np.zeros(256, np.uint8) for _ in range(6))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^`{|}~"]] = 1
_MARK[[ord(c) for c in "!?\"'()[];:"]] = 1
_BAR[ord("|")] = 1
_LINE[10] = 1


def _distinct(values: np.ndarray, bounds: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values, and the count of its commonest."""
    n = len(bounds) - 1
    key = (text.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24))
    order = np.argsort(key)
    v, t = key[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t[at], runs)
    return np.bincount(t[at], minlength=n).astype(float), most.astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, over the whole text; null and empty texts give zeros."""
    column = texts.text_array(column)
    out = np.zeros((len(column), len(STATISTICS)))
    for a, b in texts.chunks(column, texts.FEW_BYTES):
        n = b - a
        data, offsets = texts.buffers(column.slice(a, n))
        size = np.maximum(np.diff(offsets), 1).astype(float)
        share = lambda table, d=data, o=offsets, s=size: texts.sums_by(table[d], o) / s
        starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
        bounds = texts.per_text(text, n)
        k = np.diff(bounds).astype(float)
        words = np.maximum(k, 1)
        h = texts.span_hashes(data, starts, ends)
        length = (ends - starts).astype(float)
        per_word = lambda values, o=bounds, w=words: texts.sums_by(values, o) / w
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        distinct, top = _distinct(h, bounds, text)
        grams = texts.run_hashes(h, 3)
        whole = text[2:] == text[:-2] if len(text) > 2 else np.zeros(0, bool)
        g, gt = grams[whole], text[: len(grams)][whole]
        gb = texts.per_text(gt, n)
        gk = np.diff(gb)
        distinct_grams = np.where(gk > 0, _distinct(g, gb, gt)[0] / np.maximum(gk, 1), 1.0)
        upper = texts.sums_by(_UPPER[data], np.append(starts, len(data))) if len(starts) else np.zeros(0)
        last = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0)
        columns = (
            np.log1p(k), per_word(length), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(texts.IS_SPACE.astype(np.uint8)), texts.sums_by(_LINE[data], offsets) / words,
            per_word(again), distinct / words, distinct_grams, top / words, share(_BAR), per_word(last), per_word(((upper >= 2) & (upper >= 0.5 * length)).astype(float)), per_word((length <= 3).astype(float)),
        )
        block = np.stack(columns, axis=1)
        block[k == 0] = 0
        out[a:b] = block
    return out


class Trees:
    """Node arrays of all trees: split statistic (-1 at a leaf), threshold, children, value; and each tree's root."""

    def __init__(self, feature, threshold, left, right, value, roots, base):
        self.feature, self.left, self.right, self.roots = (np.array(x, np.int32) for x in (feature, left, right, roots))
        self.threshold, self.value, self.base = np.array(threshold, float), np.array(value, float), float(base)

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        while len(x) and len(self.roots):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            low = x[rows, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
        return self.base + (self.value[node].sum(axis=1) if len(self.roots) else 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows, or with one label only, the score is constant."""
    ones = float(np.mean(y)) if len(y) else 0.5
    base = float(np.log((ones * len(y) + 1) / ((1 - ones) * len(y) + 1)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < ones < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            root = len(feature)
            roots.append(root)

            def leaf(rows, low, high, g=grad, h=hess):
                v = float(np.clip(-g[rows].sum() / (h[rows].sum() + SMOOTHING), low, high))
                for a, e in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, v * rate)):
                    a.append(e)
                return len(feature) - 1

            level = [(leaf(np.arange(len(y)), -np.inf, np.inf), np.arange(len(y)), -np.inf, np.inf)]
            for _ in range(depth):
                deeper = []
                for node, rows, low, high in level:
                    split = _split(binned[rows], grad[rows], hess[rows], cuts, directions, low, high)
                    if split is None:
                        continue
                    j, cut_at, vl, vr = split
                    goes_left = binned[rows, j] <= cut_at
                    middle = (vl + vr) / 2
                    bl, br = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(directions[j]), ((low, high), (low, high)))
                    feature[node], threshold[node], value[node] = j, float(cuts[j][cut_at]), 0.0
                    left[node] = leaf(rows[goes_left], *bl)
                    right[node] = leaf(rows[~goes_left], *br)
                    deeper += [(left[node], rows[goes_left], *bl), (right[node], rows[~goes_left], *br)]
                level = deeper
            one = Trees(feature[root:], threshold[root:], np.array(left[root:]) - root, np.array(right[root:]) - root, value[root:], [0], 0.0)
            margin = margin + one.margins(x)
    return Trees(feature, threshold, left, right, value, roots, base)


def _split(binned, grad, hess, cuts, directions, low, high):
    """Best (statistic, cut, value left, value right), None if none gains."""
    g_all, h_all = grad.sum(), hess.sum()
    gain_of = lambda g, h: g * g / (h + SMOOTHING)
    best, found = 1e-6, None
    for j, c in enumerate(cuts):
        k = len(c)
        if not k:
            continue
        gl = np.cumsum(np.bincount(binned[:, j], grad, k + 1))[:k]
        hl = np.cumsum(np.bincount(binned[:, j], hess, k + 1))[:k]
        nl = np.cumsum(np.bincount(binned[:, j], minlength=k + 1))[:k]
        vl, vr = np.clip(-gl / (hl + SMOOTHING), low, high), np.clip(-(g_all - gl) / (h_all - hl + SMOOTHING), low, high)
        gain = gain_of(gl, hl) + gain_of(g_all - gl, h_all - hl) - gain_of(g_all, h_all)
        gain[(nl < LEAST_ROWS) | (len(binned) - nl < LEAST_ROWS)] = -1
        gain[(vr - vl) * directions[j] < 0] = -1
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, found = float(gain[i]), (j, i, float(vl[i]), float(vr[i]))
    return found


def _labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y, by): the ``most`` labelled documents of least hash. Rows without a label or text are passed over."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("__id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.groupBy("__id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    # Bounded by ``most`` rows of two integers, so broadcasting it doesn't grow with the corpus.
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("__doc"), "text")
    return own.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "y", "__id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents; only their statistics reach the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "id", "x"])
        texts.give_back()

    rows = _labelled(docs, labels, "quality", sample).mapInArrow(measure, "y int, id bigint, x array<double>").toPandas()
    rows = rows.sort_values("id", kind="stable")
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(STATISTICS))
    return fit(x, rows["y"].to_numpy(float), np.array([*STATISTICS.values()]))


def scored(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality, keep) for each row of ``docs``.

    A null text or one without words scores 0 and isn't kept. Rows that repeat are scored
    each; a null doc_id is carried. Only doc_id and text are read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _score(batch.column(1), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= threshold)], names=["doc_id", "quality", "keep"])
        texts.give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, quality double, keep boolean")


def _score(column: pa.Array, trees: Trees) -> np.ndarray:
    x = statistics(column)
    s = np.zeros(len(x))
    some = x[:, 0] > 0
    for k in range(0, len(x), 2048):
        at = np.flatnonzero(some[k : k + 2048]) + k
        s[at] = trees.scores(x[at])
    return s


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps, with all their columns."""
    names = docs.columns
    at = names.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(batch.column(at), trees) >= threshold))
        texts.give_back()

    return docs.mapInArrow(good, docs.schema)
