"""Near duplicates: SimHash fingerprints and a self-join by blocks of their bits.

A document's fingerprint has 256 bits, 64 of them indexed, and sums the hashes of its
distinct words (lower case). Two fingerprints are near if the indexed bits differ in at most
``budget`` places and all bits in at most ``budget_all``. The join is exact: it finds every
such pair, at any size. Fingerprints that agree in some bits (by the pigeonhole principle; the more
fingerprints, the more bits) are a task; one too large for a worker is dealt to parts, every two of which are a task.
A worker compares cells of rows, as matrices, with the cells that differ in few bits. Documents of equal fingerprint are one node; near
nodes are joined into groups by connected components, and a group keeps its least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from . import texts

BUDGET, BUDGET_ALL = 11, 52
#: The indexed bits are four blocks of 16; by the pigeonhole principle some block of a near pair
#: differs in at most budget // 4 places. Of ``parts`` of that block all but budget // 4 agree.
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints of a task on average, and times that many that a worker joins at most; rows of a cell that are compared at once.
PER_TASK, LARGE, PER_CELL = 100_000, 4, 64
#: Rows of tasks that are handed to a worker together, on average; small tasks would cost more to hand over than to do.
PER_BUNDLE = 100_000
#: Most parts of a block: with 8, and budget // 4 = 2, a fingerprint is in 28 tasks for each block, with those that share 12 bits.
MOST_PARTS = 8
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """Four uint64 for each text. A text without words is hashed as a whole, so only equal ones agree."""
    column = texts.text_array(column)
    out = np.zeros((len(column), 4), np.uint64)
    for a, b in texts.chunks(column, texts.FEW_BYTES):
        raw = column.slice(a, b - a)
        data, offsets = texts.buffers(pc.utf8_lower(raw))
        starts, ends, text = texts.spans(data, offsets, texts.IS_WORD)
        h = texts.span_hashes(data, starts, ends)
        # Distinct words of each text: sort by hash within text.
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        bounds = texts.per_text(text, b - a)
        with_words = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(with_words):
            half = (bounds[1:] - bounds[:-1])[with_words, None]
            for k, seed in enumerate(_SEEDS):
                bits = np.unpackbits(texts.mix(h ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, bounds[with_words], axis=0, dtype=np.int32)
                out[a + with_words, k] = np.packbits(2 * ones >= half, axis=1, bitorder="little").view(np.uint64)[:, 0]
        none = np.flatnonzero(bounds[1:] == bounds[:-1])
        if len(none):
            data, offsets = texts.buffers(raw)
            whole = texts.span_hashes(data, offsets[none], offsets[none + 1])
            for k, seed in enumerate(_SEEDS):
                out[a + none, k] = texts.mix(whole ^ seed)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = fingerprints(batch.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, k]) for k in range(4))], names=["doc_id", "f0", "f1", "f2", "f3"])
    texts.give_back()


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0 .. f3) of the rows with a text and an id."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInArrow(_fingerprint_batches, "doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def parts_for(n: int, radius: int, per_task: int = PER_TASK) -> int:
    """Parts of a block for ``n`` fingerprints: as few as give tasks of ``per_task`` on average."""
    for parts in range(radius + 1, max(radius + 1, MOST_PARTS if radius else 1) + 1):
        if n / 2 ** (BLOCK_BITS * (parts - radius) / parts) <= per_task:
            break
    return parts


@lru_cache(8)
def _places(parts: int, radius: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(block, mask) of every place: all choices of ``parts`` - ``radius`` parts of every block; and each place's
    order of the 256 bits: the mask's first, then the block's others, the others of the indexed ones, the rest."""
    edges = np.linspace(0, BLOCK_BITS, parts + 1).astype(int)
    each = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(each, parts - radius)]
    places = [(block, mask) for block in range(BLOCKS) for mask in masks]
    order = [sorted(range(256), key=lambda k: (k >= 64, k // BLOCK_BITS != block or k >= 64, not (k // BLOCK_BITS == block and mask >> k % BLOCK_BITS & 1), k)) for block, mask in places]
    return places, np.array(order, np.int64)


def _bits(f: np.ndarray) -> np.ndarray:
    """(n, 256) from (n, 4) words."""
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), 32), axis=1, bitorder="little")


class Linked:
    """Least row that each of ``n`` rows is linked with so far."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.least[i], self.least[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.least, np.maximum(i, j), np.minimum(i, j))
            while (up := self.least[self.least] != self.least).any():
                self.least[up] = self.least[self.least[up]]


def block_join(f: np.ndarray, side: np.ndarray, own: bool, place: int, parts: int, budget: int, budget_all: int, linked: Linked | None = None, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of rows of ``f`` (n, 4), which agree in the place's mask: all pairs, or those of the two that ``side`` tells apart.

    Rows are sorted into cells by bits of the place's block that the mask leaves open, the more rows the more bits. The rows of a cell
    are compared, ``at_once`` pairs at a time, with those of all cells that differ from it in at most budget // 4 of these bits.
    A pair that an earlier place also finds is left to that one. ``linked`` gets the pairs too; those that it has linked already are passed over
    where they are the bulk of a cell.
    """
    radius = budget // BLOCKS
    places, _ = _places(parts, radius)
    block, mask = places[place]
    open_bits = [k for k in range(BLOCK_BITS) if not mask >> k & 1][: max(0, (len(f) // PER_CELL).bit_length())]
    cell = np.zeros(len(f), np.int64)
    for k in open_bits:
        cell = cell << 1 | (f[:, 0] >> np.uint64(BLOCK_BITS * block + k) & np.uint64(1)).astype(np.int64)
    order = np.lexsort((side, cell))
    sorted_cells, sides, index = cell[order], side[order], f[order, 0]
    last = 1 << len(open_bits)
    edges = np.searchsorted(sorted_cells, np.arange(last + 1))
    near = np.array(sorted((x for x in range(last) if x.bit_count() <= radius), key=lambda x: (x.bit_count(), x)), np.int64)

    def compare(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``left`` and ``right`` are places in the order; if ``same``, only pairs in order count."""
        wide = max(1, at_once // max(len(right), 1))
        for lo in range(0, len(left), wide):
            part = left[lo : lo + wide]
            for first in range(0, len(right), at_once):
                other = right[first : first + at_once]
                x, y = np.divmod(np.flatnonzero(np.bitwise_count(index[part][:, None] ^ index[other]) <= budget), len(other))
                i, j = part[x], other[y]
                if same:
                    i, j = i[i < j], j[i < j]
                ok = _first(index[i] ^ index[j], parts, budget) == place
                i, j = order[i[ok]], order[j[ok]]
                ok = np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64) <= budget_all
                i, j = i[ok], j[ok]
                if len(i):
                    if linked is not None:
                        linked.add(i, j)
                    yield np.minimum(i, j), np.maximum(i, j)

    def apart(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``compare``, but without the pairs within the largest group that ``linked`` knows."""
        if linked is None or len(left) * len(right) <= at_once:
            yield from compare(left, right, same)
            return
        step = max(1, at_once // len(right))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            name, other = linked.least[order[part]], linked.least[order[right]]
            names, counts = np.unique(other, return_counts=True)
            bulk = names[counts.argmax()]
            if counts.max() * 2 < len(right):
                yield from compare(part, right, same)
                continue
            yield from compare(part[name != bulk], right, same)
            yield from compare(part[name == bulk], right[other != bulk], same)

    for c in np.flatnonzero(np.diff(edges)).tolist():
        mine = np.arange(edges[c], edges[c + 1])
        if own:
            others = (c ^ near)[(c ^ near) > c]
            yield from apart(mine, mine, True)
        else:
            others = c ^ near
            mine = mine[sides[mine] == 0]
        others = others[edges[others + 1] > edges[others]]
        if not len(others) or not len(mine):
            continue
        n = edges[others + 1] - edges[others]
        right = np.repeat(edges[others] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        if not own:
            right = right[sides[right] == 1]
        if len(right):
            yield from apart(mine, right, False)


def _first(differ: np.ndarray, parts: int, budget: int) -> np.ndarray:
    """The first place that finds a pair with these differing bits."""
    radius = budget // BLOCKS
    out = np.full(len(differ), -1)
    for place, (block, mask) in reversed([*enumerate(_places(parts, radius)[0])]):
        bits = (differ >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)
        out[(np.bitwise_count(bits) <= radius) & (bits & np.uint64(mask) == 0)] = place
    return out


def near_pairs(prints: DataFrame, budget: int = BUDGET, budget_all: int = BUDGET_ALL, per_task: int = PER_TASK, links: bool = False) -> DataFrame:
    """(a, b): node ids of near fingerprints. ``prints`` has node and f0 .. f3, one row for each fingerprint.

    Every fingerprint is in one task for each place, by its bits there; in a task
    all agree in those bits and near pairs are found cell by cell. A task of more than LARGE * ``per_task`` is dealt to parts by a hash, and
    every two parts are a task of at most about that size. ``links``: what a worker finds is given as links from each node to
    the least one that it is connected with there: the same groups, and no more rows than members.
    """
    radius = budget // BLOCKS
    n = prints.count()
    parts = parts_for(n, radius, per_task)
    places, _ = _places(parts, radius)
    most = LARGE * per_task
    bundles = max(64, n * len(places) // PER_BUNDLE)
    # A task's number is exact: place and bits, and below them two parts.
    value = [F.shiftleft(F.lit(k).cast("bigint"), BLOCK_BITS).bitwiseOR(F.shiftrightunsigned("f0", BLOCK_BITS * block).bitwiseAND(F.lit(mask))) for k, (block, mask) in enumerate(places)]
    four = ("f0", "f1", "f2", "f3")
    every = prints.select("node", *four, F.explode(F.array(*value)).alias("at"))
    large = cut(every.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > most).select("at", F.ceil(2 * F.col("n") / most).cast("int").alias("deal")))
    both = F.expr("shiftleft(at, 32)")
    if large.isEmpty():
        tasks = every.select(both.alias("task"), F.lit(0).alias("side"), "node", *four)
    else:
        # A row of ``large`` stands for ``most`` rows at least, so it is small beside the table.
        dealt = every.join(F.broadcast(large), "at", "left").withColumn("deal", F.coalesce("deal", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node", "f0", "f1"), "deal").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
        tasks = dealt.select((both + F.least("mine", "other") * 65536 + F.greatest("mine", "other")).alias("task"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "node", *four)

    def join(bundle: pa.Table) -> pa.Table:
        task = bundle.column("task").to_numpy()
        order = np.argsort(task, kind="stable")
        task, node, side = task[order], bundle.column("node").to_numpy()[order], bundle.column("side").to_numpy()[order]
        f = np.empty((len(order), 4), np.uint64)
        for k, name in enumerate(four):
            f[:, k] = bundle.column(name).to_numpy().view(np.uint64)[order]
        cuts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            if hi - lo < 2:
                continue
            t = int(task[lo])
            linked = Linked(hi - lo) if links else None
            for i, j in block_join(f[lo:hi], side[lo:hi], t >> 16 & 65535 == t & 65535, t >> 32 + BLOCK_BITS, parts, budget, budget_all, linked):
                if not links:
                    a.append(node[i + lo])
                    b.append(node[j + lo])
            if links:
                i = np.flatnonzero(linked.least != np.arange(hi - lo))
                a.append(node[i + lo])
                b.append(node[linked.least[i] + lo])
        out = pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})
        del task, node, side, f, order, bundle
        texts.give_back()
        return out

    return tasks.withColumn("bundle", F.pmod(F.xxhash64("task"), F.lit(bundles))).groupBy("bundle").applyInArrow(join, "a bigint, b bigint")


def _prints(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, f0 .. f3) and the number of rows with them."""
    return cut(with_fingerprints(docs).groupBy("doc_id", "f0", "f1", "f2", "f3").agg(F.count("*").alias("n_rows")))


def _groups(prints: DataFrame, budget: int, budget_all: int) -> DataFrame:
    if not 0 <= budget < 64:
        raise ValueError("budget must be from 0 to 63")
    nodes = cut(prints.groupBy("f0", "f1", "f2", "f3").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    # Node ids are doc_ids; where one id has several fingerprints they are one node already.
    edges = near_pairs(nodes, budget, budget_all, links=True).where("a <> b")
    components = connected_components(edges, "a", "b").withColumnsRenamed({"node": "c_node", "component": "c_component"})
    grouped = nodes.join(components, nodes["node"] == components["c_node"], "left").where("n > 1 OR c_component IS NOT NULL").select("f0", "f1", "f2", "f3", F.coalesce("c_component", "node").alias("group_doc_id"))
    return prints.join(grouped, ["f0", "f1", "f2", "f3"]).groupBy("doc_id").agg(F.min("group_doc_id").alias("group_doc_id")).withColumn("kept", F.col("doc_id") == F.col("group_doc_id"))


def near_groups(docs: DataFrame, budget: int = BUDGET, budget_all: int = BUDGET_ALL) -> DataFrame:
    """(doc_id, group_doc_id, kept): the documents that share a group with another, the group's
    least doc_id, and whether the document is the one kept.

    Rows with a null text or doc_id belong to no group. A doc_id that repeats counts once if
    its texts have one fingerprint. Texts without words group only with equal texts.
    Documents that resemble no other give no row. Other columns are not read.
    """
    return _groups(_prints(docs), budget, budget_all)


def deduplicate(docs: DataFrame, budget: int = BUDGET, budget_all: int = BUDGET_ALL) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of least doc_id.

    Rows with a null text or doc_id stay; of several rows with one doc_id and text one stays.
    """
    prints = _prints(docs)
    drop = _groups(prints, budget, budget_all).where("NOT kept").select(F.col("doc_id").alias("__drop"))
    kept = docs.join(drop, docs["doc_id"] == drop["__drop"], "left_anti")
    twice = prints.where("n_rows > 1").select(F.col("doc_id").alias("__twice")).distinct()
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_anti")
    again = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_semi")
    return once.unionByName(again.where("text IS NULL")).unionByName(again.where("text IS NOT NULL").dropDuplicates(["doc_id", "text"]))


def _mixed(x: str) -> str:
    """The splitmix64 finaliser of an unsigned number in SQL."""
    times = lambda e, c: f"((({e})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = times(f"xor({x}, ({x}) >> {shift})", factor)
    return f"xor({x}, ({x}) >> 31)"


def oracle(budget: int = BUDGET, budget_all: int = BUDGET_ALL) -> str:
    """Fingerprints from the texts, all pairs of them, and their components."""
    power = texts._P % (1 << 64)
    words = r"regexp_extract_all(lower(text), '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')"
    bit = lambda k, b: f"CASE WHEN 2 * sum((g{k} >> {b}) & 1) >= count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END"
    four = ", ".join(f"f{k}" for k in range(4))
    differ = [f"bit_count(xor(x.f{k}, y.f{k})::BIT)" for k in range(4)]
    return f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
    l AS MATERIALIZED (SELECT r, unnest(CASE WHEN len({words}) = 0 THEN [text] ELSE list_distinct({words}) END) AS word FROM t),
    v AS MATERIALIZED (SELECT word, hex(word) AS x, len(hex(word)) // 2 AS n FROM (SELECT DISTINCT word FROM l)),
    p(i, p) AS (SELECT 0, 1::UBIGINT UNION ALL SELECT i + 1, ((p::UHUGEINT * {power}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT FROM p WHERE i < (SELECT max(n) FROM v)),
    pp AS MATERIALIZED (SELECT i, p FROM p),
    c AS (SELECT word, unnest(range(0, n)) AS i, x, n FROM v),
    s AS (SELECT word, sum((('0x' || substr(x, 2 * i + 1, 2))::INT + 1)::HUGEINT * p::HUGEINT % 18446744073709551616) AS s FROM c JOIN pp USING (i) GROUP BY word),
    h AS MATERIALIZED (SELECT v.word, {_mixed('u')} AS h FROM (SELECT word, ((coalesce(s, 0) + n) % 18446744073709551616)::UBIGINT AS u FROM v LEFT JOIN s USING (word)) v),
    g AS MATERIALIZED (SELECT word, {", ".join(f"{_mixed(f'xor(h, {int(seed)}::UBIGINT)')} AS g{k}" for k, seed in enumerate(_SEEDS))} FROM h),
    f AS MATERIALIZED (SELECT r, {", ".join("(" + " + ".join(bit(k, b) for b in range(64)) + f") AS f{k}" for k in range(4))} FROM l JOIN g USING (word) GROUP BY r),
    prints AS MATERIALIZED (SELECT DISTINCT doc_id, {four} FROM t JOIN f USING (r)),
    nodes AS MATERIALIZED (SELECT {four}, min(doc_id) AS node, count(*) AS n FROM prints GROUP BY {four}),
    e AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM nodes x JOIN nodes y ON x.node < y.node WHERE {differ[0]} <= {budget} AND {" + ".join(differ)} <= {budget_all}),
    both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
    part AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
    SELECT doc_id, min(coalesce(root, node)) AS group_doc_id, doc_id = min(coalesce(root, node)) AS kept FROM prints JOIN nodes USING ({four}) LEFT JOIN part USING (node) WHERE n > 1 OR root IS NOT NULL GROUP BY doc_id"""
