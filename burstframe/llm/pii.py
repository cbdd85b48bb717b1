"""Personal identifiers and secrets by bootstrapped contextual extraction.

Candidates are tokens with a digit or an at sign (joined where a number is written in groups), and
those without either that a strict seed describes (password=..., or what follows 'token ='). Each
occurrence has lexical patterns: the candidate's shape, its shape with the word before or
after, and the words around it with only its coarse class, which links different shapes. A few strict seeds of each kind (an address with a domain, a card number with a right check
digit, ...) and some harmless numbers (versions, short numbers) start off the graph of patterns and
instances over the whole corpus. In every round a pattern's confidence in a kind comes
from the scores of its distinct instances, and an instance's score from its patterns' confidences
(noisy-or). The patterns that end up sure find identifiers that no seed describes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import texts

#: Most rounds; they end as soon as the sure patterns stay the same.
ROUNDS = 10
#: Weight of an instance of unknown nature against one known to be harmless, in a pattern's confidence.
UNKNOWN = 0.05
#: A pattern counts from this confidence and number of distinct instances; an occurrence is reported from this score.
CONFIDENCE, SUPPORT, REPORT = 0.5, 3, 0.5
#: Characters of what follows a key and = or :, to be a secret.
LEAST_SECRET = 12
#: Digits, or characters, of what a context alone may tell.
LEAST_DIGITS, LEAST_MIXED = 7, 8
CHUNK = 4 << 20
#: Sure patterns that are sent to the workers (a hundred bytes each); more are joined with the occurrences instead.
MOST_SENT = 200_000

_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_DIGIT[ord("@")] = 1
_SIGN = np.zeros(256, np.int32)
_SIGN[[ord("="), ord(":")]] = 1

_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_GROUP = re.compile(r"\+?\(?\d{1,4}\)?")
_LAST = re.compile(r"\d{2,4}[-.]\d{3,4}(?:[-.]\d{2,4})?")
_PHONE = re.compile(r"\+\d{1,3} ?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]\d{3,4}")
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}")
_SECRET = re.compile(r"(?:password|passwd|secret|token|api_?key)[=:]\S{8,}", re.I)
_HARMLESS = re.compile(r"[vV]?\d{1,4}(?:\.\d{1,3}){0,2}|\d{1,2}[:/]\d{1,2}(?:[:/]\d{2,4})?|(?:19|20)\d\d-\d\d-\d\d|\d{1,3}(?:,\d{3})*(?:\.\d+)?%?")
_MARK = re.compile(r"[0-9@]")
_MIXED = re.compile(r"[0-9A-Za-z_+/-]{12,}")


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(odd)) % 10 == 0


def seed(instance: str, before: str) -> str | None:
    """The kind of a strict seed, 'none' for a harmless number, None if it isn't known."""
    if _EMAIL.fullmatch(instance):
        return "email"
    if _KEY.fullmatch(instance) or _SECRET.fullmatch(instance) or re.fullmatch(r"(password|token|secret|api_?key) [=:]", before) and len(instance) >= LEAST_SECRET:
        return "secret"
    if _IP.fullmatch(instance):
        return "ip" if all(int(x) < 256 for x in instance.split(".")) else None
    if _PHONE.fullmatch(instance):
        return "phone"
    digits = re.sub(r"[ -]", "", instance)
    if digits.isdigit() and 13 <= len(digits) <= 19 and luhn(digits):
        return "card"
    if _HARMLESS.fullmatch(instance):
        return "none"
    return None


def shape(instance: str) -> str:
    """Letters as a or A, digits counted; a long token of mixed letters and digits by its alphabet and length."""
    key, eq, rest = instance.partition("=")
    if eq and key.isalpha() and _MIXED.fullmatch(rest):
        return f"{key.lower()}={shape(rest)}"
    if _MIXED.fullmatch(instance) and re.search(r"\d", instance) and re.search(r"[A-Za-z]", instance):
        alphabet = "h" if re.fullmatch(r"[0-9a-f]+", instance) else "X" if instance == instance.upper() else "x"
        return f"{alphabet}{{{len(instance)}}}"
    if "@" in instance:
        return re.sub(r"\w+", "w", instance)
    if _IP.fullmatch(instance):
        return "9.9.9.9"
    out = re.sub(r"\d+", lambda m: f"9{{{len(m[0])}}}", instance)
    return re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", out) if not out.isdigit() else out


def candidates(text: bytes, tokens: list[tuple[int, int]], marked: list[int]) -> Iterator[tuple[int, int, str, str, str]]:
    """(byte start, byte end, instance, words before, word after) of a text's candidates.

    ``tokens`` are the spans of ink, ``marked`` those with a digit or an at sign, or that a seed may describe without.
    """
    word = lambda i: text[tokens[i][0] : tokens[i][1]].decode("utf-8", "replace") if 0 <= i < len(tokens) else ""
    k = 0
    while k < len(marked):
        i = j = marked[k]
        raw = word(i)
        lead = len(raw) - len(raw.lstrip("\"'`([{<«“,;:"))
        if raw[lead - 1 : lead] == "(" and ")" in raw:
            lead -= 1
        core = re.sub(r"[^\w)]+$", "", raw[lead:])
        if core.endswith(")") and "(" not in core:
            core = core.rstrip(")")
        start, end = tokens[i][0] + len(raw[:lead].encode()), tokens[i][0] + len(raw[: lead + len(core)].encode())
        k += 1
        if _GROUP.fullmatch(core) and len(core) == len(raw) - lead:
            while k < len(marked) and marked[k] == j + 1:
                nxt = word(marked[k])
                tail = re.sub(r"[^\w)]+$", "", nxt)
                last = bool(_LAST.fullmatch(tail))
                if not (last or _GROUP.fullmatch(tail)) or nxt.startswith("+"):
                    break
                j = marked[k]
                core, end = f"{core} {tail}", tokens[j][0] + len(tail.encode())
                k += 1
                if last or len(tail) < len(nxt):
                    break
        if not core:
            continue
        before = re.sub(r"^\W+(?=\w)", "", word(i - 1).lower())
        if before and not re.search(r"\w", before):
            before = re.sub(r"^\W+", "", word(i - 2).lower()) + " " + before
        if not _MARK.search(raw) and seed(core, before) != "secret":
            continue
        yield start, end, core, before, re.sub(r"\W+$", "", word(j + 1).lower())


def coarse(instance: str) -> str | None:
    """'digits' or 'mixed' (with letters); None for what is too short for an identifier and isn't known to be harmless, or has an at sign."""
    if "@" in instance:
        return None
    if re.search(r"[^\W\d_]", instance):
        return "mixed" if len(instance) >= LEAST_MIXED else None
    return "digits" if len(re.sub(r"\D", "", instance)) >= LEAST_DIGITS or _HARMLESS.fullmatch(instance) else None


def patterns(instance: str, before: str, after: str) -> list[str]:
    s, c = shape(instance), coarse(instance)
    around = [f"{before} _ {after} #{c}"] if c and (before or after) else []
    return [s] + ([f"{before} _ {s}"] if before else []) + ([f"{s} _ {after}"] if after else []) + around


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The tokens with a digit or an at sign, with = or : inside, or long ones after such a sign that stands alone."""
    count = np.append(0, np.cumsum(_DIGIT[data], dtype=np.int32))
    signs = np.append(0, np.cumsum(_SIGN[data], dtype=np.int32))
    mark = (count[ends] > count[starts]) | (signs[ends - 1] > signs[starts])
    alone = (ends - starts == 1) & (signs[ends] > signs[starts])
    mark[1:] |= alone[:-1] & (text[1:] == text[:-1]) & ((ends - starts)[1:] >= LEAST_SECRET)
    return np.flatnonzero(mark)


def _each(column: pa.Array) -> Iterator[tuple[int, bytes, list]]:
    """(row, text, its candidates) of the texts that have any."""
    column = texts.text_array(column)
    for a, b in texts.chunks(column, CHUNK):
        data, offsets = texts.buffers(column.slice(a, b - a))
        if not len(data):
            continue
        starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
        marked = _marked(data, starts, ends, text)
        bounds = texts.per_text(text, b - a)
        of, first = np.unique(text[marked], return_index=True)
        for i, m, n in zip(of.tolist(), first.tolist(), [*first[1:].tolist(), len(marked)]):
            base, lo, hi = int(offsets[i]), int(bounds[i]), int(bounds[i + 1])
            tokens = list(zip((starts[lo:hi] - base).tolist(), (ends[lo:hi] - base).tolist()))
            raw = data[base : offsets[i + 1]].tobytes()
            yield a + i, raw, list(candidates(raw, tokens, (marked[m:n] - lo).tolist()))


def known(instance: str, before: str, hidden: float) -> str | None:
    """The seed kind, but None for a share ``hidden`` of all instances: what patterns find of those tells how good they are."""
    return None if zlib.crc32(instance.encode()) % 1000 < hidden * 1000 else seed(instance, before)


def occurrences(docs: DataFrame, hidden: float = 0.0) -> DataFrame:
    """(instance, seed, patterns) of every candidate in the texts."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            for _, _, some in _each(batch.column(0)):
                for _, _, instance, before, after in some:
                    found[instance, known(instance, before, hidden), tuple(patterns(instance, before, after))] = None
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([list(r[2]) for r in rows], pa.list_(pa.string()))], names=["instance", "seed", "patterns"])

    return docs.select("text").where("text IS NOT NULL").mapInArrow(extract, "instance string, seed string, patterns array<string>")


def bootstrap(docs: DataFrame, rounds: int = ROUNDS, hidden: float = 0.0) -> DataFrame:
    """(pattern, kind, confidence) of the sure patterns, from the graph over all candidates of the corpus."""
    edges = cut(occurrences(docs, hidden).select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("seed")))
    # An instance's own word on what it is: its seed kind surely, if it has one.
    scores = edges.where("seed IS NOT NULL").groupBy("instance").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    sure = sign = None
    for _ in range(rounds):
        known = scores.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct("kind", "score"))).alias("kinds"))
        linked = edges.select("instance", "pattern").join(known, "instance", "left")
        total = linked.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kinds").isNull(), UNKNOWN).otherwise(0.0)).alias("unknown"))
        by_kind = linked.where("kinds IS NOT NULL").select("pattern", F.explode("kinds").alias("kind", "score")).groupBy("pattern", "kind").agg(F.sum("score").alias("for_it"))
        shares = by_kind.withColumn("for_all", F.sum("for_it").over(Window.partitionBy("pattern"))).join(total, "pattern")
        # Any unknown number may stand between two words, so there only what is known supports a kind.
        support = F.when(F.col("pattern").rlike("_ .*#(digits|mixed)$"), F.least("n", "for_it")).otherwise(F.col("n"))
        sure = cut(shares.where((support >= SUPPORT) & (F.col("kind") != "none")).withColumn("confidence", F.col("for_it") / (F.col("for_all") + F.col("unknown") + 0.1)).where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"))
        now = sure.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind", F.round("confidence", 6)).cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
        seeds = edges.where("seed IS NOT NULL").groupBy("instance").agg(F.max("seed").alias("kind"))
        found = edges.join(sure, "pattern").join(seeds.select("instance"), "instance", "left_anti").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.0 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = seeds.withColumn("score", F.lit(1.0)).unionByName(found)
    return sure


class Detector:
    """Sure patterns: ``sure`` holds them all, or is None where ``table`` has too many of them to be sent to workers."""

    def __init__(self, sure: dict[str, list[tuple[str, float]]] | None, table: DataFrame | None = None, hidden: float = 0.0):
        self.sure, self.table, self.hidden = sure, table, hidden

    def kind(self, instance: str, before: str, after: str) -> tuple[str, float] | None:
        seeded = known(instance, before, self.hidden)
        if seeded:
            return None if seeded == "none" else (seeded, 1.0)
        miss: dict[str, float] = {}
        for p in patterns(instance, before, after):
            for kind, confidence in self.sure.get(p, ()):
                miss[kind] = miss.get(kind, 1.0) * (1 - min(confidence, 0.999))
        if not miss:
            return None
        kind = min(sorted(miss), key=miss.__getitem__)
        return (kind, 1 - miss[kind]) if 1 - miss[kind] >= REPORT else None


def detector(docs: DataFrame, rounds: int = ROUNDS, hidden: float = 0.0, most_sent: int = MOST_SENT) -> Detector:
    """What the corpus taught. At most ``most_sent`` sure patterns, each with SUPPORT distinct instances, reach the driver."""
    table = bootstrap(docs, rounds, hidden)
    if table.count() > most_sent:
        return Detector(None, table, hidden)
    sure: dict[str, list] = {}
    for r in table.orderBy("pattern", "kind").toLocalIterator():
        sure.setdefault(r["pattern"], []).append((r["kind"], r["confidence"]))
    return Detector(sure, None, hidden)


def _joined(rows: DataFrame, d: Detector) -> DataFrame:
    """(row, doc_id, kind, value, start, length, score) as ``found``, by a join of the occurrences in (row, doc_id, text) with the sure patterns."""
    hidden = d.hidden

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, raw, some in _each(batch.column(2)):
                chars = _characters(raw)
                out += [(row, instance, int(chars[start]), int(chars[end] - chars[start]), known(instance, before, hidden), patterns(instance, before, after)) for start, end, instance, before, after in some]
            row, *rest = zip(*out) if out else ((),) * 6
            at = pa.array(row, pa.int64())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=["row", "doc_id", "value", "start", "length", "seed", "patterns"])

    every = cut(rows.where("text IS NOT NULL").mapInArrow(extract, "row bigint, doc_id bigint, value string, start int, length int, seed string, patterns array<string>"))
    place = ["row", "doc_id", "value", "start", "length"]
    one = every.where("seed IS NULL").select(*place, F.explode("patterns").alias("pattern")).join(d.table, "pattern")
    scores = one.groupBy(*place, "kind").agg((1 - F.exp(F.sum(F.log(1.0 - F.least("confidence", F.lit(0.999)))))).alias("score"))
    best = scores.groupBy(*place).agg(F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), F.col("kind"))).alias("b")).select(*place, "b.*").where(F.col("score") >= REPORT)
    seeds = every.where("seed IS NOT NULL AND seed <> 'none'").select(*place, F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    return seeds.unionByName(best)


def _characters(raw: bytes) -> np.ndarray:
    """Characters before each byte of a text, and in all of it."""
    return np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def found(docs: DataFrame, learnt: Detector) -> DataFrame:
    """(doc_id, kind, value, start, length, score): every identifier, by characters of its text.

    Null and empty texts, and texts without identifiers, give no row, nor does an empty table. Rows that repeat are
    searched each; a null doc_id is carried; texts are searched whole, however long. Kinds that tie go by the alphabet. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if learnt.sure is None:
        return _joined(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), learnt).select("doc_id", "kind", "value", "start", "length", "score")
    shared, hidden = docs.sparkSession.sparkContext.broadcast(learnt.sure), learnt.hidden

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Detector(shared.value, None, hidden)
        for batch in batches:
            rows = []
            for row, raw, some in _each(batch.column(1)):
                chars = None
                for start, end, instance, before, after in some:
                    if hit := d.kind(instance, before, after):
                        chars = _characters(raw) if chars is None else chars
                        rows.append((row, hit[0], instance, int(chars[start]), int(chars[end] - chars[start]), hit[1]))
            row, kind, value, start, length, score = zip(*rows) if rows else ((),) * 6
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(score, pa.float64())], names=["doc_id", "kind", "value", "start", "length", "score"])

    return rows.mapInArrow(search, "doc_id bigint, kind string, value string, start int, length int, score double")


def masked(docs: DataFrame, learnt: Detector) -> DataFrame:
    """``docs`` with every identifier in the texts replaced by its kind, as <EMAIL>, and n_chars, if there is such a column, brought up to date.

    All rows stay: null and empty texts as they are, rows that repeat each, an empty table empty. Other columns, whatever they are named, are carried.
    """
    at = docs.columns.index("text")
    schema = docs.schema
    source = docs
    if learnt.sure is None:
        # Rows get a number that is stored, so that their spans find them again.
        numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
        ids = numbered.select(F.col("__row").alias("row"), F.lit(None).cast("bigint").alias("doc_id"), "text")
        lists = _joined(ids, learnt).groupBy("row").agg(F.collect_list(F.struct("start", "length", "kind")).alias("__spans"))
        source = numbered.join(lists, numbered["__row"] == lists["row"], "left").select(*docs.columns, "__spans")

        def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for i, some in enumerate(spans):
                    for one in sorted(some or (), key=lambda x: -x["start"]):
                        old[i] = f"{old[i][: one['start']]}<{one['kind'].upper()}>{old[i][one['start'] + one['length'] :]}"
                plain = batch.select(range(batch.num_columns - 1))
                yield plain.set_column(at, plain.schema.field(at), pa.array(old, plain.schema.field(at).type))
    else:
        shared, hidden = docs.sparkSession.sparkContext.broadcast(learnt.sure), learnt.hidden

        def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = Detector(shared.value, None, hidden)
            for batch in batches:
                new: dict[int, str] = {}
                for row, raw, some in _each(batch.column(at)):
                    parts, last = [], 0
                    for start, end, instance, before, after in some:
                        if hit := d.kind(instance, before, after):
                            parts += [raw[last:start], f"<{hit[0].upper()}>".encode()]
                            last = end
                    if parts:
                        new[row] = b"".join([*parts, raw[last:]]).decode()
                if new:
                    old = batch.column(at).to_pylist()
                    texts_ = pa.array([new.get(i, t) for i, t in enumerate(old)], batch.schema.field(at).type)
                    batch = batch.set_column(at, batch.schema.field(at), texts_)
                yield batch

    out = source.mapInArrow(mask, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
