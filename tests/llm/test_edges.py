"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from burstframe.llm import decontam, langid, packing, pii, quality, simhash, suffix, tokens, toxicity, urls

LONG = "every word of this very long text is here again and again " * 40_000
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
ROWS = [
    (1, None, None, None, None), (2, "", None, "s", 0), (3, "   \n", "en", "s", 4), (4, LONG, "en", None, len(LONG)), (5, SENTENCE + " a.b@c.org", "en", "s", 9),
    (5, SENTENCE + " a.b@c.org", "en", "s", 9), (None, SENTENCE, "en", "s", 9), (None, None, None, None, None), (7, "Grüße 🙂 " + SENTENCE, "de", "s", 9), (8, "x", "en", "s", 1), (9, SENTENCE + " a.b@c.org", "en", "s", 9),
    (5, "another text of the same id", "en", "s", 9),
]
#: Names that operators use themselves.
CLASHES = {n: n for n in ("shard", "bin", "size", "node", "a", "b", "n", "kind", "score", "place", "template", "host", "group_doc_id", "kept", "anchor", "__drop", "__id", "y")}
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in CLASHES)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASHES.values()) for r in ROWS], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, None), (99, 0, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)


def test_packing(odd, none):
    p = packing.pack(odd).toPandas()
    pieces = [(i, n) for r in p.itertuples() for i, n in zip(r.doc_ids, r.lengths)]
    found = {i for i, _ in pieces if i is not None and i == i}
    # Of texts only the null ones give nothing; a long one is cut up.
    assert found == {2, 3, 4, 5, 7, 8, 9} and sum(i == 5 for i, _ in pieces) == 3 and sum(i is None or i != i for i, _ in pieces) == 1
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(odd).collect()}
    assert [k for i, k in pieces if i == 2] == [1] and sum(k for i, k in pieces if i == 4) == n[4] + 1
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, sizes=())


def test_pii(odd, none):
    got = [(r["doc_id"], r["value"]) for r in pii.found(odd, pii.detector(odd)).collect()]
    assert sorted(got) == [(5, "a.b@c.org"), (5, "a.b@c.org"), (9, "a.b@c.org")]
    m = pii.masked(odd, pii.detector(odd))
    assert m.columns == odd.columns and ids(m) == ALL
    assert {r["text"] for r in m.where("doc_id = 9").collect()} == {SENTENCE + " <EMAIL>"} and m.where("doc_id = 9").first()["n_chars"] == len(SENTENCE) + 8
    assert pii.found(none, pii.detector(none)).count() == 0 and pii.masked(none, pii.detector(none)).columns == odd.columns


def test_toxicity(odd, none, labels, spark):
    field = toxicity.train(odd, labels)
    assert set(ids(toxicity.toxic_spans(odd, field))) <= set(ALL) and toxicity.toxic_spans(odd.where("text IS NULL OR trim(text) = ''"), field).count() == 0
    assert toxicity.toxic_spans(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.toxic_spans(odd, toxicity.train(odd, labels.where("false"))).count() == 0
    # Equal texts would count as one document in training.
    rows = [(i, f"you {'awful grumbleface' if i % 2 else 'kind person'} and more words here w{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    l = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_spans(d.union(d), toxicity.train(d, l)).collect()}
    assert set(got) == {i for i in range(60) if i % 2} and got[1]["span_starts"][0] <= 4


def test_quality(odd, none, labels):
    t = quality.train(odd, labels)
    got = quality.scored(odd, t)
    assert ids(got) == ALL and {(r["quality"], r["keep"]) for r in got.where("doc_id in (1, 2, 3)").collect()} == {(0.0, False)}
    kept = quality.keep_good(odd, t)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert quality.scored(none, quality.train(none, labels)).count() == 0
    assert quality.keep_good(odd, quality.train(odd, labels.where("false"))).count() == quality.scored(odd, quality.train(odd, labels.where("false"))).where("keep").count()


def test_suffix(odd, none):
    got = [tuple(r) for r in suffix.repeats(odd, width=15, gram=5).collect()]
    assert sorted(i for i, _, _ in got if i is not None) == [4, 5, 7, 9] and (4, 0, len(LONG.split())) in got and (7, 2, 19) in got and (5, 0, 20) in got and (None, 0, 19) in got
    assert suffix.repeats(none).count() == 0 and suffix.repeats(odd.where("doc_id < 3")).count() == 0
    with pytest.raises(ValueError):
        suffix.repeats(odd, width=3, gram=4)


def test_decontamination(odd, none, spark):
    b = spark.createDataFrame([(1, SENTENCE), (2, None), (3, ""), (4, "too short"), (5, SENTENCE.upper() + " more"), (1, SENTENCE)], "item_id bigint, text string")
    got = decontam.contaminated(odd, b)
    assert ids(got.where("item_id = 1")) == sorted([5, 5, 7, 9, None], key=str)
    kept = decontam.decontaminate(odd, b)
    assert kept.columns == odd.columns and ids(kept) == sorted([1, 2, 3, 4, 5, 8, None], key=str)
    empty = b.where("false")
    assert decontam.contaminated(odd, empty).count() == 0 and ids(decontam.decontaminate(odd, empty)) == ALL
    assert decontam.contaminated(none, b).count() == 0 and decontam.decontaminate(none, b).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/1", "t"), (1, "http://a.b/x/1", "t"), (None, "http://a.b/x/2", "t"), (2, None, None), (3, "", ""), (4, "http://a.b/" + "s/" * 30_000, "")], "page_id bigint, url string, template string").selectExpr("*", "1 AS host", "2 AS n", "3 AS good", "4 AS h", "5 AS p", "6 AS doc_id")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    got = urls.filtered(pages, labels).collect()
    assert len(got) == 6 and next(r for r in got if r["page_id"] == 4)["template"] == "/s" * 30_000
    assert urls.filtered(pages, labels.where("false")).where("keep").count() == 5 and urls.filtered(pages.where("false"), labels).count() == 0


def test_languages(odd, none):
    languages, logp = langid.train(odd)
    got = langid.identified(odd, languages, logp)
    assert languages == ["de", "en"] and ids(got) == ALL
    assert {(r["language"], r["margin"]) for r in got.where("doc_id in (1, 2, 3)").collect()} == {(None, 0.0)}
    assert langid.identified(none, languages, logp).count() == 0
    assert {r["language"] for r in langid.identified(odd, *langid.train(none)).collect()} == {None}


def test_tokens(odd, none):
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(odd).where("doc_id IS NOT NULL AND doc_id <> 5").collect()}
    assert got[1] is None and got[2] == 0 and got[3] > 0 and got[4] > 400_000 and ids(tokens.token_counts(odd)) == ALL
    assert tokens.token_counts(none).count() == 0


def test_simhash(odd, none):
    got = {(r["doc_id"], r["group_doc_id"], r["kept"]) for r in simhash.near_groups(odd).collect()}
    assert {(5, 5, True), (9, 5, False)} <= got and not {i for i, _, _ in got} & {1, 2, 3, 4, 8, None}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == sorted([1, 2, 3, 4, 5, 5, 8, None, None] + ([] if any(i == 7 for i, _, _ in got) else [7]), key=str)
    assert simhash.near_groups(none).count() == 0 and simhash.deduplicate(none).count() == 0
    with pytest.raises(ValueError):
        simhash.near_groups(odd, budget=64)


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, data, odd, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    sf = f"{data}/sf0.001"
    out = stage(spark, odd, sf)
    last = k == len(corpus_pipeline.STAGES) - 1
    assert (out.columns != odd.columns) == last and stage(spark, none, sf).count() == 0
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    got = stage(spark, plain, sf)
    assert last or got.columns == plain.columns


def test_pipeline(spark, data, tmp_path):
    """Each stage against what its operator decides over what the one before kept."""
    sf = f"{data}/sf0.001"
    docs, read = spark.read.parquet(f"{sf}/documents.parquet"), lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "private_data", "packing"]
    at = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], sf).write.parquet(f"{tmp_path}/{k}")
        at.append(spark.read.parquet(f"{tmp_path}/{k}"))
    good = {r["doc_id"] for r in quality.scored(docs, quality.train(docs, read("labels"))).where("keep").collect()}
    assert set(ids(at[1])) == good and len(good) < docs.count()
    gone = {r["doc_id"] for r in simhash.near_groups(at[1]).where("NOT kept").collect()}
    assert set(ids(at[2])) == good - gone and gone
    leaked = {r["doc_id"] for r in decontam.contaminated(at[2], read("benchmark")).collect()}
    assert set(ids(at[3])) == good - gone - leaked and leaked
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (at[3], at[4]))
    marked = {r["doc_id"] for r in pii.found(at[3], pii.detector(at[3])).collect()}
    assert before.keys() == after.keys() and {i for i in before if before[i] != after[i]} == marked
    run = corpus_pipeline.run(spark, sf)
    assert sorted(run.collect(), key=str) == sorted(at[5].collect(), key=str) and {i for r in run.collect() for i in r["doc_ids"]} == before.keys()
    assert pq.ParquetDataset(f"{tmp_path}/4").schema.names == run.columns
