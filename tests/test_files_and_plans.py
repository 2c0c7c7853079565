import csv
import json

import pytest
from pyspark.sql import functions as F

from broadsheet.dims import CSV_MISSING, MODELS, SURVEY_QUESTIONS, Study, VARIABLES, rating_column
from broadsheet.operators import ratings
from broadsheet.plans.agreement import merged_ratings, run_agreement
from broadsheet.plans.collect import run_collect
from broadsheet.plans.curation import run_curation
from broadsheet.plans.figures import run_figures
from broadsheet.sources import readers, writers
from broadsheet.streaming.append import append_curated, article_block_stream

LONG = "word " * 300


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


BLOCKS = (
    "---\nurl: https://a.com/1\nyear: 2020\nsource: A\nstate: CA\ntext:\n2020-01-02 murder\n\nsecond line\n\n"
    "\n---\nurl: first\nurl:  https://a.com/2 \nyear: soon\nother: x\ntext:\na text:\nb --- c\n--- d\n"
    "\n---\nsource: no text here\n"
    "\n---\n  \n"
    "\n---\ntext:\nurl: inside text"
)
PARSED = [
    ("https://a.com/1", 2020, "A", "CA", "2020-01-02 murder\n\nsecond line"),
    ("https://a.com/2", None, None, None, "a text:\nb --- c\n--- d"),
    (None, None, "no text here", None, ""),
    (None, None, None, None, "url: inside text"),
]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_read_blocks(spark, tmp_path, newline):
    path = tmp_path / "blocks.txt"
    path.write_bytes(BLOCKS.replace("\n", newline).encode())
    got = readers.read_article_blocks(spark, str(path), newline).collect()
    assert [tuple(r) for r in got] == PARSED


def test_blocks_round_trip(spark, tmp_path):
    rows = [(f"u{i}", 2018 + i % 3, "s", None if i % 2 else "CA", f"line {i}\n\n--- x\ntext:\nend {i}", ["a", "convict "], [])
            for i in range(50)]
    names = "url string, year int, source string, state string, text string, tier1_keywords array<string>, tier2_keywords array<string>"
    df = spark.createDataFrame(rows, names).repartition(3)
    path = str(tmp_path / "out")
    writers.write_article_blocks(df, path, "overwrite")
    got = sorted(tuple(r) for r in readers.read_article_blocks(spark, path).collect())
    assert got == sorted((r[0], r[1], r[2], r[3] or "", r[4]) for r in rows)
    first = next(p for p in sorted((tmp_path / "out").iterdir()) if p.name.startswith("part")).read_text()
    assert first.startswith("---\nurl: ") and "\ntier1_keywords: a;convict \ntier2_keywords: \ntext:\n" in first
    assert first.endswith("\n\n")


def test_terms_and_sources(spark, tmp_path):
    (tmp_path / "terms.txt").write_bytes(b"Killing\r\nconvict \n\n  \n-suspect\n-suspect\n")
    terms = [r.term for r in readers.read_terms(spark, str(tmp_path / "terms.txt")).collect()]
    assert terms == ["killing", "convict ", "-suspect", "-suspect"]
    path = write_csv(tmp_path / "s.csv", ["name", "state", "city", "URL", "ideology"],
                     [["A, \"x\"", "CA", "line\nbreak", "a.com", "-0.1"], ["B", "NA", "Y", "b.com", "NaN"]])
    rows = readers.read_sources(spark, path).collect()
    assert rows[0].name == 'A, "x"' and rows[0].city == "line\nbreak" and rows[0].ideology == -0.1
    assert rows[1].state is None and rows[1].ideology is None and rows[0].source_id != rows[1].source_id


def test_crawl_index(spark, tmp_path):
    folder = tmp_path / "collection=CC-MAIN-2018-43"
    folder.mkdir()
    (folder / "i.json").write_text('{"url": "http://a.com", "filename": "f", "offset": "12", "length": "3"}\n{"filename": "g"}\n')
    row, = readers.read_crawl_index(spark, str(tmp_path)).collect()
    assert (row.url, row.offset, row.length, row.collection) == ("http://a.com", 12, 3, "CC-MAIN-2018-43")


def test_missing_markers(spark, tmp_path):
    path = write_csv(tmp_path / "p.csv", ["article_id", "v"], [["1", m] for m in CSV_MISSING] + [["2", "none"]])
    rows = readers.read_people(spark, path).collect()
    assert [r.v for r in rows] == [None] * len(CSV_MISSING) + ["none"]
    assert rows[-1].art_num == 2
    bad = write_csv(tmp_path / "bad.csv", ["article_id", "v"], [["", "x"]])
    with pytest.raises(Exception, match="person without article_id"):
        readers.read_people(spark, bad).collect()


def survey_file(path, raters=2):
    columns = [f"ART{a:04d}_{q}_TEXT" if "Q2" in q or "Q1_" not in q else f"ART{a:04d}_{q}"
               for a in (1, 2, 3) for q in SURVEY_QUESTIONS.values()]
    header = ["Started", *columns]
    answers = {
        1: ["Yes", "No", "White", "Male", "Hispanic", "unknown", "Murder"],
        2: ["No", "no", "unknown", "", "black", "Female", "theft"],
        3: [""] * 7,
    }
    texts = ["Start", *("What?" for _ in columns)]
    template = ['{"ImportId":"start"}', *('{"ImportId":"QID1"}' for _ in columns)]
    unanswered = ["x", "", *("Yes" for _ in columns[1:])]
    people = [[f"day {k}", *(v for a in (1, 2, 3) for v in answers[a])] for k in range(raters)]
    if raters > 1:
        people[1][-8 - 7 : -7] = ["No", "no", "unknown", "", "black", "Female", "arson", ""]
        people[1] = people[1][: len(header)]
    return write_csv(path, header, [texts, template, *people[:1], unanswered, *people[1:]])


def people_file(path):
    columns = [rating_column(m, v) for m in MODELS for v in VARIABLES]
    first = {c: "" for c in columns} | {"gpt_crime_present": "1", "gpt_perp_race": "unknown", "llama_crime": "Murder"}
    second = {c: "no" for c in columns} | {"gpt_perp_race": "white", "qwen_perp_race": " White", "llama_crime": "theft", "qwen_crime": "Murder"}
    rows = [["1", "https://www.a.com/1", *first.values()], ["1", "https://www.a.com/1", *second.values()],
            ["2", "https://b.com/2", *second.values()], ["9", "https://b.com/9", *second.values()]]
    return write_csv(path, ["article_id", "url", *columns], rows)


def test_survey_reader_names_raters_by_position(spark, tmp_path):
    survey = readers.read_survey(spark, survey_file(tmp_path / "q.csv"))
    named = ratings.survey_respondents(survey).orderBy("rater").select("rater", "Started").collect()
    assert [tuple(r) for r in named] == [("Eleanor", "day 0"), ("Sarah", "day 1")]
    three = readers.read_survey(spark, survey_file(tmp_path / "q3.csv", raters=3))
    with pytest.raises(Exception, match="more survey rows than raters"):
        ratings.survey_respondents(three).collect()
    one = readers.read_survey(spark, survey_file(tmp_path / "q1.csv", raters=1))
    assert [r.rater for r in ratings.survey_respondents(one).collect()] == ["Eleanor"]
    assert ratings.human_ratings(one).count() == 0


def test_merged_ratings(spark, tmp_path):
    people = readers.read_people(spark, people_file(tmp_path / "p.csv"))
    survey = readers.read_survey(spark, survey_file(tmp_path / "q.csv"))
    rows = {r.art_num: r for r in merged_ratings(people, survey).collect()}
    assert set(rows) == {1, 2}  # article 3 has no answers, article 9 no coders
    assert rows[1].gpt_crime_present == "yes" and rows[1].gpt_perp_race is None  # the first one counts
    assert rows[1].qwen_perp_race == "white" and rows[1].llama_crime == "murder"
    assert rows[1].eleanor_victim_race == "other" and rows[1].eleanor_victim_gender == "unknown"
    assert rows[2].eleanor_crime_present == "no" and rows[2].eleanor_crime_label == "theft"


def test_run_agreement(spark, tmp_path):
    out = str(tmp_path / "out")
    irr = run_agreement(spark, people_file(tmp_path / "p.csv"), survey_file(tmp_path / "q.csv"), out)
    assert irr.count() == 70
    read = lambda name: spark.read.csv(f"{out}/{name}.csv", header=True)
    assert read("irr_human_only").count() == 7 and read("irr_human_vs_llm").count() == 42
    assert "Crime Label" in {r.variable for r in read("irr_human_only").collect()}
    assert read("crime_label_disagreements").columns == ["art_num", "eleanor", "sarah", "gpt", "llama", "qwen", "all_agree"]


def test_agreement_of_another_study(spark, tmp_path):
    """Other names give the same numbers; other numbers of raters give their own pairs."""
    people, survey = people_file(tmp_path / "p.csv"), survey_file(tmp_path / "q.csv")
    names = dict(zip(("eleanor", "sarah", "gpt", "llama", "qwen"), ("ann", "bob", "alpha", "beta", "m3"), strict=True))
    text = (tmp_path / "p.csv").read_text()
    for old in MODELS:
        text = text.replace(f"{old}_", f"{names[old]}_")
    (tmp_path / "p2.csv").write_text(text)
    want = run_agreement(spark, people, survey, str(tmp_path / "a")).collect()
    study = Study(("ann", "bob"), ("alpha", "beta", "m3"))
    got = run_agreement(spark, str(tmp_path / "p2.csv"), survey, str(tmp_path / "b"), study=study).collect()
    rows = lambda irr, name: sorted((r.variable, name(r.rater_1), name(r.rater_2), r.metric, r.value, r.n) for r in irr)
    assert rows(got, str) == rows(want, names.get)
    disagreed = spark.read.csv(str(tmp_path / "b" / "crime_label_disagreements.csv"), header=True)
    assert disagreed.columns == ["art_num", "ann", "bob", "alpha", "beta", "m3", "all_agree"]

    three = Study(("ann", "bob", "cy"), ("alpha",))
    survey = survey_file(tmp_path / "q3.csv", raters=3)
    irr = run_agreement(spark, str(tmp_path / "p2.csv"), survey, str(tmp_path / "c"), study=three)
    assert irr.count() == 7 * 6 and irr.where("rater_2 = 'cy' AND n > 0").count() > 0
    assert spark.read.csv(str(tmp_path / "c" / "irr_human_only.csv"), header=True).count() == 7 * 3
    alone = {(r.variable, r.rater_2): r.value for r in irr.where("rater_1 = 'ann'").collect()}
    assert all(alone[v, "bob"] == {(r.variable, r.rater_1): r.value for r in want if r.rater_2 == "sarah"}[v, "eleanor"] for v in VARIABLES)
    for bad in (("ann", "ann"), ("Ann",), ("a_b",), ("n",)):
        with pytest.raises(ValueError, match="distinct names"):
            Study(bad, ("gpt",))


def test_collect_curate_figures(spark, tmp_path):
    sources = write_csv(tmp_path / "sources.csv", ["name", "state", "city", "URL", "ideology"],
                        [["A", "CA", "X", "a.com", "-0.5"], ["B", "TX", "Y", "b.com", "0.5"]])
    index = tmp_path / "index" / "collection=CC-MAIN-2019-09"
    index.mkdir(parents=True)
    (index / "i.json").write_text("".join(
        f'{{"url": "https://{d}.com/murder-{i}", "filename": "f{d}", "offset": "{i}", "length": "1"}}\n' for d in "ab" for i in range(90)))
    html = [(f"f{d}", i, f"<body><article>{'2019-03-04 ' if i % 2 else ''}murder {LONG}</article></body>") for d in "ab" for i in range(90)]
    spark.createDataFrame(html, "filename string, offset bigint, html string").write.parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "collect")
    args = (spark, sources, str(tmp_path / "index"), str(tmp_path / "pages"))
    batch = run_collect(*args, "2018-2019", out)
    assert sorted((r.source, r["count"]) for r in batch.groupBy("source").count().collect()) == [("A", 80), ("B", 80)]
    assert run_collect(*args, "2019-2024", out).count() == 0
    matches = spark.read.csv(f"{out}/keyword_matches.csv", header=True)
    assert matches.count() == 160 and matches.columns == ["source", "state", "url", "year", "matched_keywords"]
    curated = str(tmp_path / "curated")
    assert run_curation(spark, f"{out}/matched_articles.txt", curated) == {"total": 160, "kept": 80, "no_date": 80, "no_keyword": 0}
    metadata = readers.read_curated_metadata(spark, f"{curated}/filtered_metadata.csv")
    assert metadata.count() == 80 and {r.tier1_keywords for r in metadata.collect()} == {"murder"}
    names = run_figures(spark, f"{curated}/filtered_metadata.csv", sources, people_file(tmp_path / "p.csv"), str(tmp_path / "figures"))
    assert len(names) == 7
    states = spark.read.csv(str(tmp_path / "figures" / "articles_per_state.csv"), header=True).collect()
    assert sorted((r.state, r["count"]) for r in states) == [("CA", "40"), ("TX", "40")]
    cells = spark.read.csv(str(tmp_path / "figures" / "race_representation.csv"), header=True)
    assert cells.count() == 12


def test_batches_survive_a_run_that_dies(spark, tmp_path, monkeypatch):
    from broadsheet.plans import collect

    sources = write_csv(tmp_path / "s.csv", ["name", "state", "city", "URL"], [["A", "CA", "X", "a.com"]])
    records = [{"url": f"https://a.com/murder-{i}", "filename": "f", "offset": str(i), "length": "9"} for i in range(6)]
    for collection, of in (("CC-MAIN-2018-43", records[:3]), ("CC-MAIN-2019-09", records[3:])):
        folder = tmp_path / "index" / f"collection={collection}"
        folder.mkdir(parents=True)
        (folder / "i.json").write_text("\n".join(json.dumps(r) for r in of))
    pages = [("f", i, f"<body><p>{LONG}{i}</p></body>") for i in range(6)]
    spark.createDataFrame(pages, "filename string, offset long, html string").write.parquet(str(tmp_path / "pages"))
    args = (spark, sources, str(tmp_path / "index"), str(tmp_path / "pages"))
    out = str(tmp_path / "out")

    def texts():
        blocks = readers.read_article_blocks(spark, f"{out}/matched_articles.txt")
        matches = spark.read.csv(f"{out}/keyword_matches.csv", header=True)
        return blocks.count(), matches.count(), collect.collected_so_far(spark, out).count()

    assert run_collect(*args, "2018", out).count() == 3 and texts() == (3, 3, 3)

    def dies(*_):
        raise RuntimeError("lost")

    for broken in ("write_article_blocks", "write_keyword_matches"):
        with monkeypatch.context() as patch:
            patch.setattr(collect, broken, dies)
            with pytest.raises(RuntimeError, match="lost"):
                run_collect(*args, "2018-2019", out)
        assert collect.collected_so_far(spark, out).count() == 3
    assert run_collect(*args, "2018-2019", out).count() == 3 and texts() == (6, 6, 6)
    # A repeated range adds nothing and leaves earlier batches alone.
    assert run_collect(*args, "2018-2019", out).count() == 0 and texts() == (6, 6, 6)
    # Without resuming, the new batch takes the place of all others.
    assert run_collect(*args, "2018-2019", out, resume=False).count() == 6 and texts() == (6, 6, 6)
    terms = tmp_path / "terms.txt"
    terms.write_text("murder-1\n")
    assert run_collect(*args, "2018-2019", out, resume=False, term_paths=[str(terms)]).count() == 1 and texts() == (1, 1, 1)


def test_curation_with_other_keyword_lists(spark, tmp_path):
    rows = [("u1", 2020, "s", "CA", "2020-01-02 a Zebra"), ("u2", 2020, "s", "CA", "2020-01-02 murder")]
    articles = spark.createDataFrame(rows, "url string, year int, source string, state string, text string")
    writers.write_article_blocks(articles, str(tmp_path / "blocks"), "overwrite")
    for name, text in (("one", "zebra\nZEBRA\n"), ("none", "\n")):
        (tmp_path / name).write_text(text)
    one, none = (str(tmp_path / n) for n in ("one", "none"))
    funnel = run_curation(spark, str(tmp_path / "blocks"), str(tmp_path / "out"), tier1_path=one, tier2_path=none)
    assert funnel == {"total": 2, "kept": 1, "no_date": 0, "no_keyword": 1}
    row, = spark.read.parquet(str(tmp_path / "out" / "articles")).collect()
    assert (row.url, row.tier1_keywords, row.tier2_keywords) == ("u1", ["zebra"], [])
    with pytest.raises(ValueError, match="more than 0 terms"):
        readers.load_terms(spark, one, most=0)


def test_survey_questions_with_dots(spark):
    survey = spark.createDataFrame([("R", "yes")], "rater string, `ART0001_Q2.1_VIOLENT` string")
    row, = ratings.survey_unpivot(survey).collect()
    assert tuple(row) == ("R", "ART0001_Q2.1_VIOLENT", "yes")
    people = spark.createDataFrame([(1, None, 1), (1, "x", 2)], "art_num int, `gpt_a.b` string, p int")
    row, = ratings.first_non_null(people, ["art_num"], ["gpt_a.b"], F.col("p")).collect()
    assert tuple(row) == (1, "x")


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    incoming, out, done = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "done")
    incoming.mkdir()
    for batch in range(2):
        (incoming / f"{batch}.txt").write_text(BLOCKS)
        append_curated(article_block_stream(spark, str(incoming)), out, done).awaitTermination()
        kept = spark.read.parquet(out)
        assert kept.count() == batch + 1
    assert kept.select(F.array_join("tier1_keywords", ";").alias("k")).distinct().collect()[0].k == "murder"


def test_survey_rows_beyond_the_raters_fail_in_every_projection(spark):
    from broadsheet.operators.ratings import SURVEY_FIRST_ANSWER, survey_respondents

    for n in (3, 6):
        survey = spark.createDataFrame([(i, "Yes", f"s{i}") for i in range(n)], f"row_pos long, {SURVEY_FIRST_ANSWER} string, Started string")
        for frame in (survey_respondents(survey), survey_respondents(survey).select("Started"), survey_respondents(survey).groupBy().count()):
            with pytest.raises(Exception, match="more survey rows than raters"):
                frame.collect()


def test_pages_are_found_by_file_and_offset_whatever_their_url(spark):
    from broadsheet.plans.collect import collect_articles

    sources = spark.createDataFrame(
        [(1, "A", "TX", "c", "a.com", 0.5)], "source_id long, name string, state string, city string, URL string, ideology double")
    index = spark.createDataFrame(
        [(f"https://a.com/murder/{i}", "f", i, 10, "CC-MAIN-2018-43", i) for i in range(3)],
        "url string, filename string, offset bigint, length bigint, collection string, index_pos bigint")
    html = "<body><article>" + "murder trial " * 200 + "</article></body>"
    rows = [("https://a.com/murder/0", "f", 0, html), (None, "f", 1, html), ("https://b.com/moved", "f", 2, html)]
    pages = spark.createDataFrame(rows, "url string, filename string, offset bigint, html string")
    with_url, without = (sorted(r.url for r in collect_articles(sources, index, p, "2018-2024").collect()) for p in (pages, pages.drop("url")))
    assert len(with_url) == 3 and with_url == without
