"""Hits of large dictionaries against a search for every term."""

import random

import pytest
from pyspark.sql import functions as F

from broadsheet.dims import TIER1_TERMS, TIER2_TERMS
from broadsheet.functions.text import keyword_hits
from broadsheet.operators import dictionary


def words(rng, n, letters="abcdeé -"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("bound", [500_000, 0])
def test_hits_equal_a_search_for_every_term(spark, monkeypatch, bound):
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", bound)
    rng = random.Random(7)
    terms = [*words(rng, 400), "\U0001f389", "日本語の本", "A B", "x\ny", "", None, "ab", "AB"]
    texts = [" ".join(words(rng, rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "a", "AB\U0001f389", "見る日本語の本だ", "x\nY z", texts[0], texts[0].upper(), "ab" * 30_000]
    articles = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, text string, run string")
    found = dictionary.with_dictionary_hits(articles, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert found.columns == ["id", "text", "run", "hits"]
    known = sorted({t.lower() for t in terms if t})
    got = {r.id: r.hits for r in found.collect()}
    assert got == {i: [t for t in known if t in (text or "").lower()] for i, text in enumerate(texts)}
    assert sum(map(len, got.values())) > 1000


def test_texts_are_searched_where_they_are_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    terms = docs.select(F.explode(F.split("text", " ")).alias("term")).limit(3000)
    found = dictionary.with_dictionary_hits(docs, terms).where(F.size("hits") > 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_trie_over_several_batches_and_below_its_table(most):
    import pyarrow as pa

    rng = random.Random(9)
    terms = sorted({t.encode() for t in [*words(rng, 300), "abcde" * 30, "ab" * 50]})
    texts = ["".join(words(rng, rng.randint(0, 40))) for _ in range(60)] + ["abcde" * 31, "", "ab" * 49 + "a", "ab" * 51]
    column = pa.array(["skipped", *texts], pa.binary())
    search = dictionary._trie_search(type("Shared", (), {"value": terms}), most)
    got = [hits.to_pylist() for hits in search(iter([column[1:20], column[:0], column[20:]]))]
    assert [len(g) for g in got] == [19, 0, 45]
    assert sum(got, []) == [[t.decode() for t in terms if t in text.encode()] for text in texts]


def test_agrees_with_the_built_in_lists(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", F.concat(F.lit("A Sexual-Assault of the convict -suspects "), "text").alias("text"))
    terms = spark.createDataFrame([(t,) for t in TIER1_TERMS + TIER2_TERMS], "term string")
    found = dictionary.with_dictionary_hits(docs, terms)
    assert found.where(F.col("hits") != keyword_hits(F.col("text"), TIER1_TERMS + TIER2_TERMS)).isEmpty() and found.count() == docs.count()


def test_empty_dictionary_and_table(spark):
    docs = spark.createDataFrame([(1, "abc")], "id int, text string")
    none = spark.createDataFrame([(None,), ("",)], "term string")
    assert [r.hits for r in dictionary.with_dictionary_hits(docs, none).collect()] == [[]]
    assert dictionary.with_dictionary_hits(docs.limit(0), spark.createDataFrame([("a",)], "term string")).count() == 0


def test_a_hundred_thousand_terms_in_a_plan_of_the_same_size(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, 80, "abcdefghijklmnopqrstuvwxyz")) for _ in range(200)]
    articles = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    few = [t for text in texts[:20] for t in text.split()[:5]]
    many = [*few, *{"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12))) for _ in range(100_000)}]
    frames = [dictionary.with_dictionary_hits(articles, spark.createDataFrame([(t,) for t in terms], "term string")) for terms in (few, many)]
    sizes = [len(f._jdf.queryExecution().analyzed().toString()) for f in frames]
    assert abs(sizes[0] - sizes[1]) < 300
    known = set(many)
    got = {r.id: r.hits for r in frames[1].collect()}
    for i, text in enumerate(texts):
        spans = {text[a:b] for a in range(len(text)) for b in range(a + 1, min(a + 13, len(text) + 1))}
        assert got[i] == sorted(spans & known)


def test_curation_by_tables_equals_curation_by_lists(spark, tmp_path, monkeypatch):
    from broadsheet.plans import curation
    from broadsheet.sources import writers

    rows = [(f"u{i}", 2018 + i % 5, "s", "CA", f"{'2020-01-02' if i % 3 else 'no day'} a {'Zebra crossing' if i % 2 else 'lion'} and {'owl' if i % 5 else ''} {i}") for i in range(60)]
    articles = spark.createDataFrame(rows, "url string, year int, source string, state string, text string")
    writers.write_article_blocks(articles, str(tmp_path / "blocks"), "overwrite")
    for name, text in (("one", "zebra\nZEBRA\ncross\n"), ("two", "owl\nlion\n\n"), ("none", "\n")):
        (tmp_path / name).write_text(text)
    for first, second in (("one", "two"), ("one", "none"), ("none", "two"), ("one", None)):
        found = []
        for bound in (2000, 0):
            monkeypatch.setattr(curation, "PLAN_TERMS", bound)
            out = str(tmp_path / f"{first}-{second}-{bound}")
            funnel = curation.run_curation(spark, str(tmp_path / "blocks"), out, tier1_path=str(tmp_path / first), tier2_path=second and str(tmp_path / second))
            kept = spark.read.parquet(f"{out}/articles").select("url", "tier1_keywords", "tier2_keywords", "text")
            found.append((funnel, sorted(map(str, kept.collect()))))
        assert found[0] == found[1] and found[0][0]["total"] == 60
