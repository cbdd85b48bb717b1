"""Each operator against a brute-force version, an exact round trip or held-out labels."""

import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from burstframe.llm import decontam, langid, packing, pii, quality, queries, simhash, suffix, texts, tokens, toxicity, urls
from checks import same


@pytest.fixture(scope="module")
def docs(data):
    return pq.read_table(f"{data}/sf0.01/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    same(spark, f"{data}/sf0.001", queries.queries()[name], queries.oracle_sql()[name])


# 1 packing


def brute_pack(lengths, sizes):
    left, opened, bins, to_come = [], [], [], sum(lengths)
    for n in lengths:
        fits = [b for b in range(len(left)) if left[b] >= n]
        if fits:
            b = min(fits, key=lambda b: (left[b], b))
        else:
            b = len(left)
            size = min((s for s in sizes if s >= n), key=lambda s: (packing.cost(s) / min(s, to_come), s))
            left.append(size)
            opened.append(size)
        left[b] -= n
        to_come -= n
        bins.append(b)
    return bins, [min(s for s in sizes if s >= o - r) for o, r in zip(opened, left)]


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_against_brute_force(seed):
    r = random.Random(seed)
    sizes = sorted(r.sample(range(5, 200), 4))
    lengths = sorted((r.randint(1, sizes[-1]) for _ in range(150)), reverse=True)
    assert packing.best_fit(lengths, sizes) == brute_pack(lengths, sizes)


def unpacked(p):
    """The tokens of each document, put together from its pieces."""
    found = {}
    for r in p.itertuples():
        at = np.append(0, np.cumsum(r.lengths))
        assert at[-1] == r.n_tokens == len(r.tokens)
        for k, i in enumerate(r.doc_ids):
            assert r.starts[k] == r.pieces[k] * 256
            found.setdefault(i, []).append((r.pieces[k], list(r.tokens[at[k] : at[k + 1]])))
    return {i: [t for _, part in sorted(parts) for t in part] for i, parts in found.items()}


def test_packed_pieces_give_every_document_back(spark, data):
    d = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    p = packing.pack(d, sizes=(64, 256), per_shard=200_000).toPandas()
    assert p["shard"].nunique() > 1 and not p.duplicated(["shard", "bin"]).any()
    rows = d.select("doc_id", "text").toPandas()
    (_, _, flat, bounds), = tokens.tokenizer().tokens(pa.array(rows.text))
    assert unpacked(p) == {i: [*flat[bounds[k] : bounds[k + 1]].tolist(), packing.END] for k, i in enumerate(rows.doc_id)}
    assert ((p["size"] == 64) | (p["size"] == 256) & (p.n_tokens > 64)).all() and (p.n_tokens <= p["size"]).all()


# 2 PII


def test_context_finds_identifiers_that_no_seed_describes(spark):
    rows = [(i, f"Please pay with card {n} today") for i, n in enumerate(("4111111111111111", "5500005555555559", "340000000000009", "4012888888881881", "4222222222222"))]
    rows += [(50, "Please pay with card 4111111111111112 today"), (60, "Version 1.2.3 of 2019 had 12 pages"), (61, "mail a.b@c.org or 10.0.0.1")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["kind"], r["value"]) for r in pii.found(d, pii.detector(d)).collect()}
    assert (50, "card", "4111111111111112") in got
    assert {(61, "email", "a.b@c.org"), (61, "ip", "10.0.0.1")} <= got and not any(i == 60 for i, _, _ in got)
    masked = {r["doc_id"]: r["text"] for r in pii.masked(d, pii.detector(d)).collect()}
    assert masked[50] == "Please pay with card <CARD> today" and masked[60] == rows[6][1] and masked[61] == "mail <EMAIL> or <IP>"


def test_context_crosses_from_one_shape_to_another(spark):
    rows = [(i, f"reach us at +1 ({200 + i}) 555-70{10 + i} today") for i in range(6)]
    rows += [(10, "reach us at 415-555-7040 today"), (11, "reach us at (415) 555-7041 today"), (12, "reach us at 10 today"), (13, "order 415-555-7040-1 shipped"), (14, "reach us at 12345 today")]
    rows += [(20 + i, f"fax 20{i}-555-71{10 + i} today") for i in range(3)] + [(30 + i, f"reach us at 20{i}-555-71{10 + i} today") for i in range(3)] + [(40, "parts 999-555-1234 boxed")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["kind"], r["value"]) for r in pii.found(d, pii.detector(d)).collect()}
    assert {(10, "phone", "415-555-7040"), (11, "phone", "(415) 555-7041")} <= got
    assert (40, "phone", "999-555-1234") in got  # a shape that the context taught, found outside it
    assert not {i for i, _, _ in got} & {12, 13, 14}


def test_secrets_without_digits_are_found(spark):
    rows = [(0, "set password=CorrectHorseBattery, then"), (1, "secret = abcdefghijklmnop"), (2, "the token : qwertyuiopasdf ends"), (3, "a secret: understanding ratio=height:width http://example.org/extraordinarily"), (4, "so password ="), (5, "= abcdefghijklmnop")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = pii.detector(d)
    assert {(r["doc_id"], r["kind"], r["value"]) for r in pii.found(d, known).collect()} == {(0, "secret", "password=CorrectHorseBattery"), (1, "secret", "abcdefghijklmnop"), (2, "secret", "qwertyuiopasdf")}
    masked = {r["doc_id"]: r["text"] for r in pii.masked(d, known).collect()}
    assert masked == dict(rows) | {0: "set <SECRET>, then", 1: "secret = <SECRET>", 2: "the token : <SECRET> ends"}


def test_private_data_of_the_corpus(spark, data, docs):
    got = queries.op2_pii(spark, f"{data}/sf0.01").toPandas()
    text = dict(zip(docs.doc_id, docs.text))
    assert all(text[r.doc_id][r.start : r.start + r.length] == r.value for r in got.itertuples())
    spans = {}
    for r in got.itertuples():
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    missed = total = 0
    for i, t in text.items():
        for m in re.finditer(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|\b\d{13,19}\b|\+\d[\d ()-]{7,}\d", t):
            total += 1
            missed += not any(a < m.end() and m.start() < b for a, b in spans.get(i, ()))
    assert total > 50 and missed == 0


def test_hidden_seeds_are_found_by_context(spark, data):
    """Half of the seeds are withheld; patterns find nearly all of them again."""
    d = spark.read.parquet(f"{data}/sf0.1/documents.parquet")
    every = {(r["doc_id"], r["start"]): (r["kind"], r["value"]) for r in pii.found(d, pii.Detector({})).collect()}
    half = {(r["doc_id"], r["start"]): r["kind"] for r in pii.found(d, pii.detector(d, hidden=0.5)).collect()}
    for kind in ("email", "phone", "secret"):
        hidden = [k for k, (one, value) in every.items() if one == kind and pii.zlib.crc32(value.encode()) % 1000 < 500]
        assert len(hidden) > 5 and sum(half.get(k) == kind for k in hidden) >= 0.8 * len(hidden)


def test_pattern_graph_against_a_plain_walk(spark, docs):
    rows = [(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text) if re.search(r"[@=]|\d{6}", t)][:150]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    edges, seeds = {}, {}
    for _, _, some in pii._each(pa.array([t for _, t in rows])):
        for _, _, instance, before, after in some:
            for x in pii.patterns(instance, before, after):
                edges.setdefault(x, set()).add(instance)
            if k := pii.seed(instance, before):
                seeds[instance] = max(k, seeds.get(instance, k))
    scores = {i: {k: 1.0} for i, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        sure = {}
        for x, members in edges.items():
            total, unknown = {}, sum(i not in scores for i in members) * pii.UNKNOWN
            for i in members:
                for k, v in scores.get(i, {}).items():
                    total[k] = total.get(k, 0) + v
            for k, v in total.items():
                support = min(len(members), v) if re.search(r"_ .*#(digits|mixed)$", x) else len(members)
                confidence = v / (sum(total.values()) + unknown + 0.1)
                if k != "none" and support >= pii.SUPPORT and confidence >= pii.CONFIDENCE:
                    sure[x, k] = confidence
        scores = {i: {k: 1.0} for i, k in seeds.items()}
        for (x, k), c in sure.items():
            for i in edges[x] - seeds.keys():
                one = scores.setdefault(i, {})
                one[k] = 1 - (1 - one.get(k, 0.0)) * (1 - min(c, 0.999))
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.bootstrap(d).collect()}
    assert got.keys() == sure.keys() and all(abs(got[x] - sure[x]) < 1e-4 for x in got)


def test_many_sure_patterns_are_joined_with_the_same_result(spark, data):
    d = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    few, many = pii.detector(d), pii.detector(d, most_sent=0)
    assert many.sure is None and few.sure
    plain = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["kind"], r["value"], round(r["score"], 9)) for r in df.collect())
    assert plain(pii.found(d, few)) == plain(pii.found(d, many))
    assert sorted(map(tuple, pii.masked(d, few).collect())) == sorted(map(tuple, pii.masked(d, many).collect()))


# 3 toxicity


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    transition = rng.normal(size=(2, 2))
    bounds = np.array([0, 5, 5, 6, 13])
    e = rng.normal(size=13)
    want = np.zeros(13)
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, ones = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=int(b - a)):
            w = math.exp(sum(e[a + i] for i, s in enumerate(path) if s) + sum(transition[s, t] for s, t in itertools.pairwise(path)))
            total += w
            ones += w * np.array(path)
        want[a:b] = ones / total if b > a else []
    assert np.allclose(toxicity.marginals(e, bounds, transition), want)


def test_toxic_documents_held_out(data):
    d = pq.read_table(f"{data}/sf0.1/documents.parquet").to_pandas().merge(pq.read_table(f"{data}/sf0.1/labels.parquet").to_pandas(), on="doc_id").sort_values("doc_id")
    train, test = d.iloc[:1500], d.iloc[1500:3000]
    field = toxicity.fit(pa.array(train.text), train.toxic.to_numpy(int), rounds=25)
    hit = np.zeros(len(test), bool)
    for row, _, a, b in toxicity._found(pa.array(test.text), field, toxicity.LEAST_TOKENS, toxicity.LEAST_MARGINAL):
        hit[row] = True
        assert all(0 <= x < y <= len(test.text.iloc[row]) for x, y in zip(a, b))
    toxic = test.toxic.to_numpy() == 1
    assert (hit & toxic).sum() >= 0.9 * toxic.sum() and (hit & ~toxic).sum() <= 0.01 * (~toxic).sum()


# 4 quality


def test_trees_obey_their_directions():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + rng.normal(0, 0.3, 800) > 0.5) ^ (x[:, 2] > 0.8)).astype(float)
    t = quality.fit(x, y, np.array([1, -1, 0]), trees=30)
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((50, 3)), 41, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 41), 50)
        steps = np.diff(t.margins(grid).reshape(50, 41), axis=1)
        assert (steps * sign >= -1e-12).all()
    one = lambda row, k=0: t.value[k] if t.feature[k] < 0 else one(row, t.left[k] if row[t.feature[k]] <= t.threshold[k] else t.right[k])
    assert np.allclose(t.margins(x[:50]), [t.base + sum(one(r, k) for k in t.roots) for r in x[:50]])


def test_statistics_against_plain_counting(docs):
    some = [t for t in docs.text[:60]] + ["", "a a a b", "# # x|y\nTHE THE"]
    got = quality.statistics(pa.array(some))
    names = list(quality.STATISTICS)
    for t, row in zip(some, got):
        w = re.findall(r"[^ \t\n\r\f]+", t)
        if not w:
            assert not row.any()
            continue
        g = list(zip(w, w[1:], w[2:]))
        assert row[names.index("log_words")] == pytest.approx(math.log1p(len(w)))
        assert row[names.index("distinct_words")] == pytest.approx(len(set(w)) / len(w))
        assert row[names.index("distinct_trigrams")] == pytest.approx(len(set(g)) / len(g) if g else 1.0)
        assert row[names.index("top_word")] == pytest.approx(max(map(w.count, set(w))) / len(w))
        assert row[names.index("repeats")] == pytest.approx(sum(a == b for a, b in zip(w, w[1:])) / len(w))


def test_quality_held_out(data):
    d = pq.read_table(f"{data}/sf0.1/documents.parquet").to_pandas().merge(pq.read_table(f"{data}/sf0.1/labels.parquet").to_pandas(), on="doc_id").sort_values("doc_id")
    train, test = d.iloc[:1500], d.iloc[1500:]
    t = quality.fit(quality.statistics(pa.array(train.text)), train.quality.to_numpy(float), np.array([*quality.STATISTICS.values()]))
    keep, good = quality._score(pa.array(test.text), t) >= quality.THRESHOLD, test.quality.to_numpy() == 1
    assert (keep & good).sum() >= 0.99 * good.sum() and (keep & ~good).sum() <= 0.1 * (~good).sum()


# 5 suffix arrays


@pytest.mark.parametrize("seed", range(200))
def test_suffix_array_and_common_prefixes(seed):
    r = random.Random(seed)
    n, k, spread = r.randrange(60), r.randint(1, 6), r.choice((1, 1, 3000))
    s = np.array([r.randrange(k) * spread for _ in range(n)], np.int64)
    sa = suffix.suffix_array(s)
    assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    if n > 1:
        shared = suffix.common_prefixes(s, sa)
        for a, b in zip(sa, sa[1:]):
            same_ = list(itertools.takewhile(lambda x: x[0] == x[1], zip(s[a:].tolist(), s[b:].tolist())))
            assert shared[b] == len(same_)


def test_long_repetitions_are_sorted_too():
    for s in (np.zeros(5000, int), np.tile([1, 0], 2000), np.tile(np.arange(1500), 3), np.repeat([5000, 3], 1000)):
        assert suffix.suffix_array(s).tolist() == suffix._doubling(np.asarray(s, np.int64)).tolist()


def brute_repeats(rows, width):
    seen = {}
    for i, t in {(i, t) for i, t in rows if t is not None}:
        w = t.split()
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append((i, t, k))
    spots = {}
    for v in seen.values():
        if len(v) > 1:
            for i, t, k in v:
                spots.setdefault((i, t), set()).update(range(k, k + width))
    out = []
    for (i, _), s in spots.items():
        s = sorted(s)
        start = s[0]
        for a, b in zip(s, [*s[1:], None]):
            if b != a + 1:
                out.append((i, start, a - start + 1))
                start = b
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, width, gram, per_shard", [(0, 8, 3, 10), (1, 8, 8, 1000), (2, 5, 1, 1), (3, 12, 4, 1)])
def test_repeats_against_brute_force(spark, seed, width, gram, per_shard):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randint(width - 2, 3 * width))) for _ in range(6)]
    filler = lambda: " ".join(str(r.randrange(40)) for _ in range(r.randrange(30)))
    rows = [(i, "\n".join(x for _ in range(r.randrange(4)) for x in (filler(), r.choice(passages)))) for i in range(25)]
    rows += [(90, passages[0] * 3), (91, None), (92, ""), rows[0], rows[0], (None, passages[1]), (93, "x " * 100), (94, "x " * width)]
    got = suffix.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), width, gram, per_shard)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows, width)


# 6 decontamination


@pytest.mark.parametrize("seed", range(5))
def test_wu_manber_against_find(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab ") for _ in range(9000))
    patterns = sorted({text[k : k + n] for k, n in ((r.randrange(8900), r.randint(seed + 1, 40)) for _ in range(40))} | {"b" * 30})
    got = sorted(decontam.WuManber([p.encode() for p in patterns]).search(np.frombuffer(text.encode(), np.uint8)))
    want = sorted((m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(f"(?={re.escape(p)})", text))
    assert got == want


def test_several_automata_find_the_same(spark, data, monkeypatch):
    d, b = (spark.read.parquet(f"{data}/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    once = sorted(map(tuple, decontam.contaminated(d, b).collect()))
    patterns = [k.encode() for k in sorted({r["pattern"] for r in decontam.windows(b).collect()})]
    assert sorted(map(tuple, decontam.contaminated(d, b, per_pass=len(patterns) // 3).collect())) == once
    assert decontam.decontaminate(d, b, per_pass=len(patterns) // 2).count() == d.count() - len({i for i, _, _ in once})
    monkeypatch.setattr(decontam, "MOST_PATTERNS", 20)
    automata = decontam._automata(patterns)
    assert len(automata) > 3 and sorted(k for ids, _ in automata for k in ids) == list(range(len(patterns)))
    column = pa.array([r[0] for r in d.select(decontam.normalised(d["text"])).collect()])
    assert len({row for row, _ in decontam.matches(column, automata)}) == len({i for i, _, _ in once})


def test_every_excerpt_of_thirteen_words_is_found(spark):
    item = [f"word{i}" for i in range(31)]
    b = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    rows = [(i, f"before {' '.join(item[i : i + 13])} after") for i in range(19)] + [(50, " ".join(item[3:15])), (51, " ".join(item))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["item_id"], r["n_windows"]) for r in decontam.contaminated(d, b).collect()}
    assert got == {i: (7, 1) for i in range(19)} | {51: (7, 19)}
    assert [r["doc_id"] for r in decontam.decontaminate(d, b).collect()] == [50]


def test_items_of_any_length_are_found_as_a_whole(spark):
    items = ["x", "ab", "two words", "an item of six words here", "eleven words make this one a little longer than most are", "\u6f22\u5b57"]
    b = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    rows = [(i, f"so {t.upper()}  then") for i, t in enumerate(items)] + [(10, "xx abc two  wordss an item of six words"), (11, "X"), (12, "two words and ab")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in decontam.contaminated(d, b).collect())
    assert got == sorted([(i, i, 1) for i in range(len(items))] + [(11, 0, 1), (12, 1, 1), (12, 2, 1)])


# 7 URLs


def test_templates_generalise_merge_and_reject(spark):
    pages, labels, k = [], [], 0
    for i in range(60):
        for path, good in ((f"shop/{i}/buy", 0), (f"blog/2024/post-{i}", 1), (f"news/{'abcdefghij'[i % 10]}/x", 1)):
            pages.append((k, f"https://Site.org:443/{path}?q=1"))
            labels.append((k, good))
            k += 1
    pages += [(k, None), (k + 1, "nonsense"), (k + 2, "http://new.org/")]
    out = {r["page_id"]: r for r in urls.filtered(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert len(out) == len(pages) and out[0]["template"] == "/shop/*/buy" and not out[0]["keep"]
    assert out[1]["keep"] and out[1]["host"] == "site.org" and out[1]["template"].startswith("/") and "*" in out[1]["template"]
    assert out[2]["template"] == "/news/+/x" and out[2]["keep"]
    assert (out[k]["host"], out[k]["purity"], out[k]["keep"]) == (None, 0.0, False) and out[k + 1]["host"] == "" and out[k + 2]["keep"]


def test_branches_that_part_deep_in_the_path_are_judged_apart(spark):
    pages, labels = [], []
    for i in range(40):
        for part, good in (("x", 1), ("casino", 0)):
            pages.append((len(pages), f"http://site.org/en/2024/05/17/news/{part}/page"))
            labels.append((len(labels), good))
    deep = "/".join(["a"] * 6)
    pages.append((len(pages), f"http://deep.org/{deep}"))
    out = {r["page_id"]: r for r in urls.filtered(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert len(out) == len(pages) and out[len(pages) - 1]["template"] == f"/{deep}"
    assert all(out[i]["template"] == "/en/*/*/*/news/" + ("casino/page" if i % 2 else "x/page") and out[i]["keep"] == (i % 2 == 0) for i in range(80))


def test_planted_bad_hosts_and_branches_are_rejected(spark, data):
    pages = spark.read.parquet(f"{data}/sf0.1/pages.parquet").select("page_id", "url").toPandas()
    bad_host = pages.url.str.contains("casino|pills|bets|spam")
    extra = [(10**6 + i, f"https://good.org/{part}/{i}/view") for i in range(200) for part in (("news", "deals") if i % 2 else ("blog", "deals"))]
    rows = list(zip(pages.page_id.tolist(), pages.url)) + [(i * 2 + k % 2, u) for k, (i, u) in enumerate(extra)]
    bad = {i for i, b in zip(pages.page_id.tolist(), bad_host) if b} | {i for i, u in rows if "/deals/" in u}
    labels = [(i, int(i not in bad)) for i, _ in rows if i % 3 == 0]
    d, l = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    out = {r["page_id"]: r for r in urls.filtered(d, l).collect()}
    assert len(bad) > 250 and sum(not out[i]["keep"] for i in bad) >= 0.98 * len(bad) and all(r["keep"] for i, r in out.items() if i not in bad)
    # Branches without labels stay apart from siblings that differ.
    rows = [(i, f"http://a.org/{p}/x") for i, p in enumerate(["good"] * 30 + ["bad"] * 30 + ["new"] * 5)]
    out = urls.filtered(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id bigint, quality int"))
    assert {(r["template"], r["keep"]) for r in out.collect()} == {("/good/x", True), ("/bad/x", False), ("/new/x", True)}


# 8 languages


def test_forward_sums_over_all_segmentations():
    p = langid.Pieces()
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(len(p.pieces)), 2).T)
    at = {x: i for i, x in enumerate(p.pieces)}
    words = ["the", "a", "être", "Straße", "xyz", "w" * 60]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.append(0, ends[:-1])
    got = langid.log_probabilities(p, logp, data, starts, ends)
    for k, w in enumerate(words):
        b = (" " + w).encode()
        alpha = np.zeros((len(b) + 1, 2))
        alpha[0] = 1
        for j in range(1, len(b) + 1):
            for i in range(max(0, j - p.longest), j):
                if b[i:j] in at:
                    alpha[j] += alpha[i] * np.exp(logp[at[b[i:j]]])
        assert np.allclose(got[k], np.log(alpha[-1]))


def test_languages_of_only_long_words_are_learnt(monkeypatch):
    p = langid.Pieces()
    words = {"x": {b"abcab" * 12: 2, b"the": 3, b"q" * 300: 1}, "z": {"\u6f22\u5b57".encode() * 20: 1}}
    got = langid.fit(p, words)
    assert np.isfinite(got).all() and np.allclose(np.exp(got).sum(axis=0), 1)
    assert got[p.pieces.index(b"q"), 0] > got[p.pieces.index(b"q"), 1]
    assert all(len(x) == 0 for x in langid.padded(*[np.zeros(0, np.int64)] * 3))
    monkeypatch.setattr(langid, "LONG", 100)
    short = {"x": {w: n for w, n in words["x"].items() if len(w) <= 100}, "z": words["z"]}
    want = langid.fit(p, short)
    monkeypatch.setattr(langid, "LONG", 2)
    assert np.allclose(langid.fit(p, short), want)


def test_languages_held_out(spark, data, docs):
    d = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    got = langid.identified(d.where("doc_id % 2 = 1"), *langid.train(d.where("doc_id % 2 = 0"))).toPandas().merge(docs, on="doc_id")
    assert (got.language == got.lang).mean() > 0.97


def test_scripts_without_blanks_are_learnt_and_told_apart(spark):
    some = {"zh": "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65", "ja": "\u4eca\u65e5\u306f\u3068\u3066\u3082\u3044\u3044\u5929\u6c17\u3067\u3059\u306d", "th": "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35\u0e21\u0e32\u0e01", "en": "the weather is fine today and we walk in the park"}
    d = spark.createDataFrame([(i, lang, t * 20) for i, (lang, t) in enumerate(some.items())], "doc_id bigint, lang string, text string")
    got = {r["doc_id"]: r["language"] for r in langid.identified(d, *langid.train(d)).collect()}
    assert got == {i: lang for i, lang in enumerate(some)}


# 9 tokens


def test_token_counts_are_those_of_the_tokenizer(docs):
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [*docs.text[:300], "", "   \n\n x", "aaaaaaaaaaaaaaaaaaaaa", "日本語 ﷽ 🙂🙂", "don't I'LL", "<|endoftext|>", None, "x" * 5000, " " * 3000]
    n, k = tokens.tokenizer().counts(pa.array(some))
    assert n.tolist() == [-1 if t is None else len(encoding.encode_ordinary(t)) for t in some] and k[6 + 300] == -1
    ids = {}
    for a, b, flat, bounds in tokens.tokenizer().tokens(pa.array(some)):
        ids |= {a + i: flat[bounds[i] : bounds[i + 1]].tolist() for i in range(b - a)}
    assert [ids[i] for i in range(len(some))] == [encoding.encode_ordinary(t or "") for t in some]


@pytest.mark.parametrize("seed", range(20))
def test_pretokens_are_those_of_the_pattern(seed):
    import regex

    r = random.Random(seed)
    alphabet = ["a", "s", "t", "ll", "ve", "re", "S", "é", "漢", "1", "²", "'", "'", " ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "-", "🙂", "\u0301", "_"]
    some = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(300)]
    data, offsets = texts.buffers(pa.array(some))
    starts, ends = tokens.pretokens(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == [w for t in some for w in regex.findall(tokens.PATTERN, t)]


# 10 SimHash


@pytest.mark.parametrize("budget, per_task", [(0, 50_000), (3, 30), (11, 50_000), (11, 100), (11, 20)])
def test_trie_join_finds_every_pair_once(spark, budget, per_task):
    """Also with tasks so small that the trie is split again and again, and with equal indexed bits."""
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, (60, 4), dtype=np.int64)
    rows = [base[i % 60].copy() for i in range(600)]
    for r in rows[60:]:
        for bit in rng.integers(0, 64, rng.integers(0, 14)):
            r[0] ^= np.int64(1) << np.int64(bit) if bit < 63 else np.int64(-(2**63))
        for bit in rng.integers(0, 63, rng.integers(0, 60)):
            r[rng.integers(1, 4)] ^= np.int64(1) << np.int64(bit)
    rows += [base[0] ^ np.array([0, k, 0, 0]) for k in range(1, 41)]
    f = np.unique(np.array(rows), axis=0)
    n = len(f)
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(f)], "node bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    got = [tuple(sorted(p)) for p in simhash.near_pairs(df, budget, 52, per_task).collect()]
    x = (f[:, None] ^ f[None]).view(np.uint64)
    one, all_ = np.bitwise_count(x[:, :, 0]), np.bitwise_count(x).sum(axis=2)
    assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if one[i, j] <= budget and all_[i, j] <= 52]


def test_a_crowd_gives_few_links_and_the_same_groups(spark, monkeypatch):
    """Links grow with the documents of a crowd, not with its pairs; also where a task is dealt to parts."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, (4, 4), dtype=np.int64)
    crowd = np.array([centres[i % 2] ^ np.array([1 << int(rng.integers(63)), 1 << int(rng.integers(63)), 1 << int(rng.integers(63)), 0]) for i in range(800)])
    chain = np.array([centres[2 + i % 2] ^ np.array([(1 << 6 * (i // 2)) - 1, 0, 0, 0]) for i in range(20)])
    f = np.unique(np.concatenate([crowd, chain, rng.integers(0, 2**63, (100, 4), dtype=np.int64)]), axis=0)
    f = f[rng.permutation(len(f))]
    n, x = len(f), (f[:, None] ^ f[None]).view(np.uint64)
    near = (np.bitwise_count(x[:, :, 0]) <= 11) & (np.bitwise_count(x).sum(axis=2) <= 52)
    least = np.arange(n)
    while (step := np.where(near, least[None], n).min(axis=1)).tolist() != least.tolist():
        least = step
    prints = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(f)], "doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    given = []
    monkeypatch.setattr(simhash, "connected_components", lambda edges, a, b, real=simhash.connected_components: given.append(edges.count()) or real(edges, a, b))
    many = simhash.near_pairs
    for per_task in (50_000, 20):
        monkeypatch.setattr(simhash, "near_pairs", lambda nodes, *budgets, per_task=per_task, **more: many(nodes, *budgets, per_task, **more))
        got = {r["doc_id"]: r["group_doc_id"] for r in simhash._groups(prints, 11, 52).collect()}
        assert got == {i: g for i, g in enumerate(least.tolist()) if (least == g).sum() > 1}
    assert given[0] < 2 * n < near.sum() // 20


def test_more_fingerprints_share_more_bits():
    assert [simhash.parts_for(n, 2) for n in (10, 10**6, 5 * 10**6, 10**7, 10**9)] == [3, 3, 4, 4, 8] and simhash.parts_for(10**12, 0) == 1
    for parts, radius in ((3, 2), (8, 2), (5, 1), (1, 0)):
        places, orders = simhash._places(parts, radius)
        assert all(sorted(o) == list(range(256)) for o in orders.tolist())
        assert all({k % 16 for k in o[: mask.bit_count()]} == {k for k in range(16) if mask >> k & 1} and all(k // 16 == block for k in o[:16]) for (block, mask), o in zip(places, orders.tolist()))


def test_near_copies_share_a_group_and_others_do_not(spark):
    r = random.Random(0)
    rows = []
    for g in range(20):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for c in range(3):
            v = list(w)
            for _ in range(6):
                v[r.randrange(200)] = f"x{r.randrange(10**6)}"
            rows.append((g * 10 + c, " ".join(v)))
        rows.append((g * 10 + 5, " ".join(f"y{r.randrange(10**6)}" for _ in range(200))))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["group_doc_id"], r["kept"]) for r in simhash.near_groups(d).collect()}
    # The join is exact, fingerprints are not: nearly all copies are found, and nothing else.
    assert all(i % 10 < 3 and i // 10 == g // 10 and k == (i == g) for i, (g, k) in got.items()) and len(got) >= 56


def test_fingerprints_count_distinct_words():
    f = simhash.fingerprints(pa.array(["b a", "A b a", "a c", "", None, "--", "--", "++"]))
    assert (f[0] == f[1]).all() and (f[0] != f[2]).any() and (f[5] == f[6]).all() and (f[5] != f[7]).any()


def test_spans_and_hashes_do_not_depend_on_place():
    data, offsets = texts.buffers(pa.array(["ab cd", "cd  ab", None, "abcd"]))
    starts, ends, text = texts.spans(data, offsets, texts.IS_INK)
    h = texts.span_hashes(data, starts, ends).tolist()
    assert text.tolist() == [0, 0, 1, 1, 3] and h[0] == h[3] and h[1] == h[2] and len(set(h)) == 3


def test_a_worker_needs_little_memory_beside_the_text():
    column = pa.array([f"{'some words of a text of usual length, ' * 50}{i}" for i in range(4000)])
    for f in (quality.statistics, simhash.fingerprints):
        f(column[:10])
        tracemalloc.start()
        f(column)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
        tracemalloc.stop()
