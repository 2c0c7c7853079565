import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from broadsheet.dims import STATE_POPULATION
from broadsheet.operators import crawl, curation, series
from broadsheet.plans.collect import collect_articles

LONG = "word " * 300
INDEX = "url string, filename string, offset bigint, collection string, index_pos int"


def sources_df(spark, rows):
    df = spark.createDataFrame(rows, "name string, state string, city string, URL string")
    return df.withColumn("source_id", F.concat_ws("/", "name", "URL"))


def test_collect_articles(spark):
    sources = sources_df(spark, [
        ("A", "CA", "X", "https://ex.com/home"), ("B", "TX", None, "b.com"), ("C", "NY", "Y", "www.c.com"),
        ("A2", "CA", "X", "ex.com")])
    page = f"<body><article>{LONG}</article></body>"
    records = [
        ("https://ex.com/murder-1", "f", 1, "CC-MAIN-2018-43", 1),
        ("https://ex.com/murder-1", "f", 2, "CC-MAIN-2024-51", 2),   # same page, other collection
        ("https://news.ex.com/a_suspect", "f", 3, "CC-MAIN-2018-43", 3),
        ("https://ex.com/sports", "f", 4, "CC-MAIN-2018-43", 4),     # no keyword
        ("https://b.com/murder", "f", 5, "CC-MAIN-2018-43", 5),      # source is incomplete
        (None, "f", 6, "CC-MAIN-2018-43", 6),
        ("https://www.c.com/murder", "f", 7, "CC-MAIN-2018-43", 7),
        ("https://ex.com/murder-2", "f", 8, "CC-MAIN-2021-04", 8),   # collection of no year
        ("https://ex.com/murder-short", "f", 9, "CC-MAIN-2018-43", 9),
        ("https://c.com/murder", "f", 10, "CC-MAIN-2018-43", 10)]
    index = spark.createDataFrame(records, INDEX)
    pages = spark.createDataFrame(
        [("f", i, "<body>short</body>" if i == 9 else page) for i in range(1, 11)],
        "filename string, offset bigint, html string")
    got = collect_articles(sources, index, pages, "2018-2024").collect()
    assert sorted((r.source, r.url, r.year) for r in got) == [
        ("A", "https://ex.com/murder-1", 2018), ("A", "https://ex.com/murder-1", 2024),
        ("A", "https://news.ex.com/a_suspect", 2018),
        ("A2", "https://ex.com/murder-1", 2018), ("A2", "https://ex.com/murder-1", 2024),
        ("A2", "https://news.ex.com/a_suspect", 2018), ("C", "https://www.c.com/murder", 2018)]
    assert {r.text for r in got} == {LONG.strip()}
    assert {tuple(r.matched_keywords) for r in got} == {("murder",), ("_suspect",)}
    done = spark.createDataFrame([("https://ex.com/x", 2018), ("https://www.c.com/y", 2017)], "url string, year int")
    again = collect_articles(sources, index, pages, "2018-2024", done).collect()
    assert sorted((r.source, r.year) for r in again) == [("A", 2024), ("A2", 2024), ("C", 2018)]


def test_resume_keeps_later_years_and_unseen_domains(spark):
    targets = spark.createDataFrame(
        [("a.com", 2018), ("a.com", 2019), ("a.com", 2020), ("b.com", 2018), (None, 2018)], "domain string, year int")
    done = crawl.last_year_per_domain(spark.createDataFrame(
        [("https://a.com/1", 2018), ("https://a.com/2", 2019), ("https://www.b.com/1", 2024)], "url string, year int"))
    left = crawl.resume_filter(targets, done).collect()
    assert sorted((r.domain or "", r.year) for r in left) == [("", 2018), ("a.com", 2020), ("b.com", 2018)]


def test_cap_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"s{i % 7}", 2020 + i % 2, rng.randint(0, 6), rng.randint(0, 3), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "source_id string, year int, variant_pos int, coll_pos int, index_pos int")
    groups = defaultdict(list)
    for r in rows:
        groups[r[:2]].append(r[2:])
    want = {(*k, *v) for k, vs in groups.items() for v in sorted(vs)[:80]}
    got = crawl.cap_per_source_year(df.repartition(8))
    assert {tuple(r) for r in got.collect()} == want
    # Both ranks are limited before they are computed, which cuts rows ahead of the shuffles.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2


def test_terms_from_lines(spark):
    lines = spark.createDataFrame([("Killing\r",), ("convict ",), ("",), (" \t",), ("-suspect",), ("-suspect",)], "value string")
    assert sorted(r.term for r in curation.terms_from_lines(lines).collect()) == [
        "-suspect", "-suspect", "convict ", "killing"]


def test_funnel_and_curate_agree(spark):
    rows = [(1, "2020-01-02 murder"), (2, "murder"), (3, "2020-01-02"), (4, "2020-01-02 -suspect"), (5, ""), (6, None),
            (7, "2020-01-02 Sexual-Assault -Suspects")]
    df = spark.createDataFrame(rows, "id int, text string")
    funnel = curation.curation_funnel(df).collect()[0]
    assert tuple(funnel) == (7, 2, 3, 2)
    kept = {r.id: (r.tier1_keywords, r.tier2_keywords) for r in curation.curate(df).collect()}
    assert kept == {1: (["murder"], []), 7: (["assault", "sexual-assault"], ["-suspect", "-suspects"])}
    same = curation.keep_curated(curation.with_outcome(df)).collect()
    assert {r.id: (r.tier1_keywords, r.tier2_keywords) for r in same} == kept
    assert {r.id for r in curation.body_keyword_filter(df).collect()} == {1, 2, 7}


def test_ideology_series_with_duplicate_and_missing_domains(spark):
    articles = spark.createDataFrame(
        [(f"https://www.a.com/{i}",) for i in range(6)] + [("http://b.com/x",), ("http://c.com",), (None,)], "url string")
    sources = spark.createDataFrame(
        [("a.com", -0.5), ("https://a.com/home", 0.3), ("b.com", 0.1), ("c.com", None), (None, 1.0)], "URL string, ideology double")
    joined = sorted(r.ideology for r in series.articles_with_ideology(articles, sources).collect())
    assert joined == [-0.5] * 6 + [0.1] + [0.3] * 6 + [1.0]
    scores = series.ideology_scores(articles, sources)
    assert [r["count"] for r in series.ideology_bin_counts(scores).collect()] == [6, 1, 7]
    hist = {r.bin: r["count"] for r in series.ideology_hist(scores).collect()}
    assert len(hist) == 19 and sum(hist.values()) == 14 and hist[19] == 1
    row = series.ideology_mean_median(scores).collect()[0]
    assert math.isclose(row.mean, sum(joined) / 14) and math.isclose(row.median, (joined[6] + joined[7]) / 2)


def test_states_and_regions(spark):
    df = spark.createDataFrame([(s,) for s in ["CA", "CA", "TX", "DC", "ca", None, "WA", "FL"]], "state string")
    assert [(r.state, r["count"]) for r in series.state_counts(df).collect()] == [("CA", 2), ("FL", 1), ("TX", 1), ("WA", 1)]
    assert [tuple(r) for r in series.region_counts(df).collect()] == [("West", 3, 2), ("South", 2, 2)]


def test_race_series_equal_person_by_person(spark):
    rng = random.Random(9)
    raw = ["white", " White", "black", "asian", "unknown", "multiple", "not provided", "not_provided", "", None]
    sources = [("a.com", -0.4, "CA"), ("b.com", 0.2, "DC"), ("b.com", 0.9, "XX"), ("c.com", 0.0, "TX"), ("http://d.com", 0.4, "TX")]
    people = [(f"https://www.{rng.choice('aaabcd')}.com/{i}", *(rng.choice(raw) for _ in range(6))) for i in range(500)]
    columns = [f"{m}_{r}_race" for r in ("perp", "victim") for m in ("gpt", "llama", "qwen")]
    pdf = spark.createDataFrame(people, "url string, " + ", ".join(f"{c} string" for c in columns))
    sdf = spark.createDataFrame(sources, "URL string, ideology double, state string")

    def three(v, missing):
        v = (v or "").strip().lower()
        return None if v in missing else v if v in ("white", "black") else "other"

    def vote(values):
        given = [v for v in values if v is not None]
        leaders = {v for v in given if given.count(v) == max(map(given.count, given))}
        return leaders.pop() if len(leaders) == 1 else None

    counts, observed, expected = Counter(), Counter(), Counter()
    for url, *answers in people:
        host = url.split("/")[2].removeprefix("www.")
        for domain, score, state in sources:
            if domain != host or score == 0:
                continue
            sign = "negative" if score < 0 else "positive"
            for role, votes in (("perp", answers[:3]), ("victim", answers[3:])):
                race = vote([three(v, ("", "not_provided", "unknown", "not provided", "multiple")) for v in votes])
                if race:
                    counts[role, race, sign] += 1
                cleaned = [None if (v or "").strip().lower() in ("", "not_provided") else v.strip().lower() for v in votes]
                race = three(vote(cleaned), ("", "not_provided", "unknown"))
                if race and state in STATE_POPULATION:
                    white, black = STATE_POPULATION[state]
                    observed[sign, role, race] += 1
                    for r, share in (("white", white), ("black", black), ("other", 1 - white - black)):
                        expected[sign, role, r] += share
    got = series.race_counts(pdf, sdf)
    assert {(r.role, r.race, r.ideology): r["count"] for r in got.collect()} == counts
    cells = series.with_oe_ratio_ci(series.race_oe(pdf, sdf)).collect()
    assert len(cells) == 12
    for r in cells:
        key = (r.ideology, r.role, r.race)
        assert r.observed == observed[key] and math.isclose(r.expected, expected[key], abs_tol=1e-9)
    shares = series.race_share(series.race_rollup_all(got)).collect()
    for panel in ("negative", "positive", "all"):
        assert math.isclose(sum(r.proportion for r in shares if r.ideology == panel), 1)
    empty = series.race_oe(pdf.limit(0), sdf).collect()
    assert len(empty) == 12 and {(r.observed, r.expected) for r in empty} == {(0, 0.0)}


def test_rollup_cleans_labels_first(spark):
    rows = [("perp", " White", "negative", 2), ("perp", "white", "positive", 3), ("perp", None, "negative", 1),
            ("perp", "not provided", "negative", 9), ("victim", "none", "positive", 9)]
    counts = spark.createDataFrame(rows, "role string, race string, ideology string, count bigint")
    got = sorted((r.race, r.ideology, r["count"]) for r in series.race_rollup_all(counts).collect())
    assert got == [("nan", "all", 1), ("nan", "negative", 1), ("white", "all", 5), ("white", "negative", 2), ("white", "positive", 3)]
