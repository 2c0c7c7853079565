"""Collection of articles: texts join in last, html is neither shuffled nor sorted."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import crawl
from broadsheet.plans.collect import collect_articles

WORD = "murder trial of the year "


def nodes(df):
    """(name, output columns, simple text) of every operator of the physical plan."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        output, children = node.output(), node.children()
        found.append((node.nodeName(), {output.apply(i).name() for i in range(output.size())}, node.simpleString(1000)))
        left += [children.apply(i) for i in range(children.size())]
    return found


def carrying(df, names, columns):
    return [text for name, output, text in nodes(df) if name in names and output & columns]


@pytest.fixture
def crawl_tables(spark):
    rng = random.Random(4)
    sources = spark.createDataFrame([(i, f"S{i}", "TX", "c", f"s{i % 3}.com") for i in range(4)],
                                    "source_id long, name string, state string, city string, URL string")
    index = [(f"https://{rng.choice(['', 'www.', 'm.'])}s{i % 3}.com/{rng.choice(['murder', 'weather'])}/{i}", f"f{i % 5}", i // 2, 10,
              rng.choice(["CC-MAIN-2018-43", "CC-MAIN-2024-10", "CC-MAIN-2024-18"]), i) for i in range(1500)]
    index = spark.createDataFrame(index, "url string, filename string, offset bigint, length bigint, collection string, index_pos bigint")
    pages = [(f"f{i}", o, f"<body><p>{i} {o} {WORD * (60 if (i + o) % 4 else 2)}</p></body>") for i in range(5) for o in range(800)]
    return sources, index, spark.createDataFrame(pages, "filename string, offset bigint, html string")


def plainly(sources, index, pages):
    """The same articles with whole pages carried through, as the stage is defined."""
    return crawl.with_matched_keywords(plainly_ranked(sources, index, pages)).select("source", "state", "url", "year", "matched_keywords", "text")


def plainly_ranked(sources, index, pages):
    candidates = crawl.crawl_candidates(crawl.crawl_targets(sources, "2018-2024"), crawl.url_keyword_filter(index))
    return crawl.cap_per_source_year(crawl.extract_articles(crawl.fetch_pages(candidates, pages)))


@pytest.mark.parametrize("bound", [500_000, 0])
def test_late_texts_give_the_same_articles(spark, crawl_tables, monkeypatch, bound):
    monkeypatch.setattr(crawl, "BROADCAST_KEYS", bound)
    sources, index, pages = crawl_tables
    got, want = (sorted(map(str, f(sources, index, pages).collect())) for f in (lambda *t: collect_articles(*t, "2018-2024"), plainly))
    assert got == want and len(got) > 300
    capped = {}
    for row in collect_articles(sources, index, pages, "2018-2024").groupBy("source", "year").count().collect():
        capped[row.source, row.year] = row["count"]
    assert max(capped.values()) == 80


@pytest.mark.parametrize("bound", [500_000, 0])
def test_no_sort_holds_text_or_html(spark, crawl_tables, monkeypatch, bound):
    monkeypatch.setattr(crawl, "BROADCAST_KEYS", bound)
    sources, index, pages = crawl_tables
    candidates = crawl.crawl_candidates(crawl.crawl_targets(sources, "2018-2024"), crawl.url_keyword_filter(index))
    texts, final = crawl.page_texts(candidates, pages, 10), collect_articles(sources, index, pages, "2018-2024")
    for frame in (texts, final):
        assert not carrying(frame, {"Sort", "SortMergeJoin", "Window", "WindowGroupLimit"}, {"html", "text"})
        if bound:
            assert not carrying(frame, {"Exchange"}, {"html", "text"})
        else:
            assert carrying(frame, {"ShuffledHashJoin"}, {"html", "text"})
    assert carrying(plainly_ranked(sources, index, pages), {"Sort"}, {"text"})  # the test does see such sorts


def test_html_of_a_bucketed_table_stays_where_it_is(spark, crawl_tables, monkeypatch, tmp_path):
    monkeypatch.setattr(crawl, "BROADCAST_KEYS", 0)
    sources, index, pages = crawl_tables
    name = f"pages_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS crawl_test LOCATION '{tmp_path}'")
    try:
        crawl.store_page_table(pages, f"crawl_test.{name}", 4)
        table = spark.table(f"crawl_test.{name}")
        candidates = crawl.crawl_candidates(crawl.crawl_targets(sources, "2018-2024"), crawl.url_keyword_filter(index))
        found = crawl.page_texts(candidates, table, 10)
        assert carrying(found, {"ShuffledHashJoin"}, {"html"}) and not carrying(found, {"Exchange", "Sort"}, {"html"})
        assert carrying(crawl.page_texts(candidates, pages, 10), {"Exchange"}, {"html"})  # a plain table is shuffled
        want = crawl.page_texts(candidates, pages, 10)
        assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    finally:
        spark.sql("DROP DATABASE crawl_test CASCADE")


def test_a_page_is_parsed_once(spark, crawl_tables):
    sources, index, pages = crawl_tables
    candidates = crawl.crawl_candidates(crawl.crawl_targets(sources, "2018-2024"), crawl.url_keyword_filter(index))
    texts = crawl.page_texts(candidates, pages, 10)
    assert texts.count() == texts.select(*crawl.PAGE_KEY).distinct().count() < candidates.count()
    assert texts.where(F.length("text") <= 1000).isEmpty()
