"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.dims import (
    BINARY_VARIABLES, MODELS, NOMINAL_VARIABLES, RATERS, ROLES, SURVEY_QUESTIONS, TIER1_TERMS, TIER2_TERMS,
    keyword_terms, rating_column,
)
from broadsheet.functions import labels, scores, urls, votes
from broadsheet.functions.html import html_text
from broadsheet.functions.text import compute_once, has_date, hits_in_lowered, min_chars, with_lowered
from broadsheet.operators import agreement, crawl, curation, ratings, series
from broadsheet.operators.dictionary import with_dictionary_hits
from broadsheet.plans.agreement import update_agreement
from broadsheet.plans.collect import collect_articles
from broadsheet.sources import readers, writers
from broadsheet.storage import shared_path as scratch
from workload.views import Tables

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}

YEARS = "2018-2024"


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    return query_as(build.__name__)(build)


def query_as(name: str):
    """For queries whose name is that of the expression they apply."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        BUILDERS[name] = build
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over_folder(build: Callable[[Tables], DataFrame]):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: over_folder(build) for name, build in BUILDERS.items()}


def joined(column: str):
    return F.array_join(column, ";").alias(column)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources and sinks --------------------------------------------------------


@query
def src_keywords(t: Tables) -> DataFrame:
    """The lines of all documents, written as keyword files and read as terms."""
    path = scratch(t.spark, "keywords")
    t.documents.select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return readers.read_terms(t.spark, path).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def src_sources(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sources")
    t.inventory.write.csv(path, **writers.CSV_OPTIONS)
    rows = crawl.complete_sources(readers.read_sources(t.spark, path))
    return rows.select("name", "state", "city", F.col("URL").alias("source_url"))


def _index(t: Tables) -> DataFrame:
    return t.crawl_index.withColumnRenamed("rec_offset", "offset")


def _pages(t: Tables) -> DataFrame:
    return t.crawl_pages.withColumnRenamed("rec_offset", "offset")


@query
def src_crawl_index(t: Tables) -> DataFrame:
    path = scratch(t.spark, "index")
    text = [F.col(c).cast("string") for c in ("filename", "offset", "length")]
    # Every tenth record lacks its URL.
    url = F.when(F.col("index_pos") % 10 != 7, F.col("url")).alias("url")
    _index(t).select(url, *text, "collection").write.partitionBy("collection").json(path)
    return readers.read_crawl_index(t.spark, path).drop("index_pos")


@query
def crawl_table_of_years(t: Tables) -> DataFrame:
    """The index as a table sorted by host, read for two years."""
    path = scratch(t.spark, "index")
    writers.write_crawl_index(_index(t), path, 8)
    found = crawl.of_years(readers.read_crawl_table(t.spark, path), "2018-2019")
    return found.select("url", "host", "filename", "offset", "length", "collection")


@query
def src_article_blocks(t: Tables) -> DataFrame:
    path = scratch(t.spark, "blocks")
    writers.write_article_blocks(t.articles, path)
    return readers.read_article_blocks(t.spark, path)


@query
def src_people(t: Tables) -> DataFrame:
    path = scratch(t.spark, "people")
    answers = ratings.model_columns(t.people)
    # Missing answers are written as one of the markers for a missing value; some cells hold line breaks.
    marked = {c: F.coalesce(c, F.lit("N/A")) for c in answers}
    note = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit('say "'), "l_suppkey", F.lit('",\nthen'))).otherwise(F.col("url"))
    t.people.select(
        F.col("art_num").alias("article_id"), "url", "l_linenumber", *answers, note.alias("note")
    ).withColumns(marked).write.csv(path, **writers.CSV_OPTIONS)
    return readers.read_people(t.spark, path).select(
        "art_num", "url", F.col("l_linenumber").cast("int").alias("l_linenumber"), *answers, "note"
    )


def _write_exports(t: Tables, path: str) -> None:
    """Survey exports as they come: names, question texts, a template row, a row per coder."""
    questions = sorted(SURVEY_QUESTIONS.values())
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    # The cells of an article are together in the sorted columns, so they are joined first.
    cells = F.concat_ws(",", *(quoted(F.coalesce(q, F.lit(""))) for q in questions))
    articles = t.exports.select("export", "coder", "art", cells.alias("cells")).groupBy("export", "art").agg(
        F.collect_list(F.struct("coder", "cells")).alias("rows"))
    sheets = articles.groupBy("export").agg(
        F.array_sort(F.collect_list(F.struct(F.format_string("%04d", "art").alias("art"), "rows"))).alias("articles"))

    def line(first, of_article):
        return F.concat_ws(",", first, F.array_join(F.transform("articles", of_article), ","))

    def each(body):
        """A line with a cell for each name."""
        return lambda a: F.concat_ws(",", *(quoted(body(F.concat(F.lit("ART"), a["art"], F.lit(f"_{q}")))) for q in questions))

    def of_coder(coder):
        none = F.lit(",".join('""' for _ in questions))
        return line(F.concat(F.lit("export "), "export"), lambda a: F.coalesce(F.get(F.filter(a["rows"], lambda r: r["coder"] == coder), F.lit(0))["cells"], none))

    coders = F.array_sort(F.array_distinct(F.flatten(F.transform("articles", lambda a: F.transform(a["rows"], lambda r: r["coder"])))))
    head = F.array(line(F.lit("Started"), each(lambda c: c)), line(F.lit("Start"), each(lambda c: F.concat(F.lit("What,\nthen, is "), c, F.lit("?")))),
                   line(F.lit("{}"), each(lambda c: F.lit('{"ImportId":"QID1"}'))))
    # A file is one text, so its lines are in order.
    lines = sheets.select(F.col("export").alias("folder"), F.array_join(F.concat(head, F.transform(coders, of_coder)), "\n").alias("value"))
    lines.write.partitionBy("folder").text(path)


def _export_cells(t: Tables) -> DataFrame:
    path = scratch(t.spark, "exports")
    _write_exports(t, path)
    return readers.read_survey_cells(t.spark, path)


@query
def src_survey(t: Tables) -> DataFrame:
    """Every answer of every coder, read from the exports and named by position."""
    cells = _export_cells(t)
    started = cells.where("col = 'Started'").select("file_pos", F.replace("value", F.lit("export "), F.lit("")).try_cast("bigint").alias("export")).distinct()
    answers = ratings.survey_answers(cells)
    return answers.join(started.where("export IS NOT NULL"), "file_pos").select("export", "rater", "col", "value")


@query
def sink_article_blocks(t: Tables) -> DataFrame:
    path = scratch(t.spark, "blocks")
    writers.write_article_blocks(curation.curate(t.articles), path, "overwrite")
    # Whole blocks, so that their lines are compared in order.
    blocks = t.spark.read.option("lineSep", "---\nurl: ").text(path).where("value <> ''")
    return blocks.groupBy(F.col("value").alias("block")).agg(F.count(F.lit(1)).alias("n"))


def _matched_urls(t: Tables) -> DataFrame:
    return crawl.with_matched_keywords(crawl.url_keyword_filter(t.articles))


@query
def sink_keyword_matches(t: Tables) -> DataFrame:
    path = scratch(t.spark, "matches")
    writers.write_keyword_matches(_matched_urls(t), path)
    return t.spark.read.csv(path, header=True, escape='"').withColumn(
        "year", F.col("year").cast("int")
    )


@query
def sink_curated_metadata(t: Tables) -> DataFrame:
    path = scratch(t.spark, "metadata")
    writers.write_curated_metadata(curation.curate(t.articles), path)
    return readers.read_curated_metadata(t.spark, path)


@query
def sink_irr_tables(t: Tables) -> DataFrame:
    folder = scratch(t.spark, "irr")
    labels_only = ratings.normalise_ratings(t.ratings, ["crime_label"])
    writers.write_irr_tables(irr_table(t), agreement.label_disagreements(labels_only), folder)
    tables = [
        t.spark.read.csv(f"{folder}/{name}.csv", header=True).select(
            F.lit(name).alias("file"), "variable", "rater_1", "rater_2", "metric",
            F.col("value").cast("double").alias("value"), F.col("n").cast("bigint").alias("n"),
        )
        for name in ("irr_human_only", "irr_human_vs_llm")
    ]
    # The third table in the same shape: a row per article, its labels in one cell.
    raters = F.concat_ws("|", *(F.coalesce(r, F.lit("-")) for r in RATERS))
    disagreements = t.spark.read.csv(f"{folder}/crime_label_disagreements.csv", header=True).select(
        F.lit("crime_label_disagreements").alias("file"), F.lit("crime_label").alias("variable"),
        raters.alias("rater_1"), F.lit(None).cast("string").alias("rater_2"), F.col("all_agree").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.col("art_num").cast("bigint").alias("n"),
    )
    return tables[0].unionByName(tables[1]).unionByName(disagreements)


@query
def sink_race_counts(t: Tables) -> DataFrame:
    path = scratch(t.spark, "race_counts")
    writers.write_race_counts(series.race_counts(t.people, t.sources), path)
    return readers.read_race_counts(t.spark, path)


# --- expressions --------------------------------------------------------------


def _per_url(t: Tables, expression) -> DataFrame:
    return t.urls.select("doc_id", "url", expression(F.col("url")).alias("result"))


@query
def url_netloc(t: Tables) -> DataFrame:
    return _per_url(t, urls.url_netloc)


@query
def url_domain(t: Tables) -> DataFrame:
    return _per_url(t, urls.url_domain)


@query
def url_netloc_nowww(t: Tables) -> DataFrame:
    return _per_url(t, urls.url_netloc_nowww)


@query
def source_url_norm(t: Tables) -> DataFrame:
    return _per_url(t, urls.source_url_norm)


@query
def domain_variants(t: Tables) -> DataFrame:
    domains = t.urls.select("doc_id", urls.url_netloc(F.col("url")).alias("domain"))
    return crawl.with_variants(domains).select("doc_id", "variant_pos", "host")


@query
def year_range(t: Tables) -> DataFrame:
    return crawl.with_years(t.documents.select("doc_id"), "2019-2021")


@query
def keyword_hits(t: Tables) -> DataFrame:
    low = with_lowered(t.articles.select("doc_id", "text"), "text")
    hits = hits_in_lowered("_lowered", TIER1_TERMS + TIER2_TERMS)
    return low.select("doc_id", hits.alias("hits")).select("doc_id", joined("hits"))


@query
def dictionary_hits(t: Tables) -> DataFrame:
    """Hits of a dictionary that grows with the data: every word of the benchmark and of the articles' sources."""
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("term")).unionByName(t.documents.select(F.col("source").alias("term")))
    found = with_dictionary_hits(t.articles.select("doc_id", "text"), words)
    return found.select("doc_id", joined("hits"))


@query
def url_keyword_filter(t: Tables) -> DataFrame:
    return crawl.url_keyword_filter(t.articles.select("doc_id", "url"))


@query
def body_keyword_filter(t: Tables) -> DataFrame:
    return curation.body_keyword_filter(t.articles).select("doc_id", "year")


@query_as("has_date")
def has_date_flag(t: Tables) -> DataFrame:
    return t.articles.select("doc_id", has_date(F.col("text")).alias("dated"))


@query_as("html_text")
def html_text_of_pages(t: Tables) -> DataFrame:
    return t.crawl_pages.select("page_id", html_text(F.col("html")).alias("text"))


@query_as("min_chars")
def min_chars_of_documents(t: Tables) -> DataFrame:
    return t.documents.where(min_chars(F.col("text"))).select("doc_id", "n_chars")


def _label_query(name: str, normalise, columns: list[str]) -> None:
    """A normaliser over all raw answers of the ratings table."""

    @query_as(name)
    def build(t: Tables) -> DataFrame:
        return t.ratings.select("art_num", *(normalise(F.col(c)).alias(c) for c in columns))


RACE_COLUMNS = [rating_column(r, f"{role}_race") for role in ROLES for r in RATERS]
LABEL_QUERIES = {
    "norm_label": (labels.norm_label, [rating_column(r, "crime_label") for r in RATERS]),
    "norm_yes_no": (labels.norm_yes_no, [rating_column(r, v) for v in BINARY_VARIABLES for r in RATERS]),
    "norm_race_irr": (labels.norm_race_irr, RACE_COLUMNS),
    "norm_gender_irr": (labels.norm_gender_irr, [rating_column(r, f"{role}_gender") for role in ROLES for r in RATERS]),
    "norm_race_oe": (labels.norm_race_oe, RACE_COLUMNS),
    "norm_race_counts": (labels.norm_race_counts, RACE_COLUMNS),
}
for _name, (_normalise, _columns) in LABEL_QUERIES.items():
    _label_query(_name, _normalise, _columns)


@query
def normalise_ratings(t: Tables) -> DataFrame:
    return ratings.normalise_ratings(t.ratings)


def _raw_race_counts(t: Tables) -> DataFrame:
    """People by raw answer of every model for every role, and by the leaning of their source."""
    answers = F.expr("stack(6, " + ", ".join(f"'{role}', '{m}', {rating_column(m, f'{role}_race')}" for role in ROLES for m in MODELS)
                     + ") AS (role, model, race)")
    people = series.people_with_ideology(t.people, t.sources)
    return people.select(F.col("ideology_label").alias("ideology"), answers).groupBy("role", "model", "race", "ideology").agg(
        F.count(F.lit(1)).alias("count"))


@query
def clean_race_series(t: Tables) -> DataFrame:
    return series.clean_race_series(_raw_race_counts(t))


def _scored(t: Tables) -> DataFrame:
    return series.articles_with_ideology(t.articles, t.sources).select("doc_id", "ideology")


@query
def ideology_sign(t: Tables) -> DataFrame:
    return _scored(t).withColumn("sign", scores.ideology_sign(F.col("ideology")))


@query
def ideology_bin(t: Tables) -> DataFrame:
    return _scored(t).withColumn("category", scores.ideology_bin(F.col("ideology")))


@query
def hist_bin_19(t: Tables) -> DataFrame:
    return _scored(t).withColumn("bin", scores.hist_bin(F.col("ideology")))


@query
def pop_other_share(t: Tables) -> DataFrame:
    per_state = t.articles.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    shares = series.people_with_population(per_state)
    return rounded(shares.select("state", "n", "other_prop"), "other_prop")


@query
def valid_state(t: Tables) -> DataFrame:
    return series.valid_state(t.articles).select("doc_id", "state")


@query
def header_normalise(t: Tables) -> DataFrame:
    untidy = t.documents.select(
        F.col("doc_id").alias(" Doc_ID"), F.col("lang").alias("LANG "), F.col("source").alias("Source")
    )
    return curation.header_normalise(untidy)


@query
def survey_key_parse(t: Tables) -> DataFrame:
    return ratings.survey_key_parse(ratings.survey_unpivot(t.survey))


@query
def survey_question_map(t: Tables) -> DataFrame:
    return ratings.survey_question_map(t.sheets)


def _votes(t: Tables, vote, variables, raters) -> DataFrame:
    return t.ratings.select(
        "art_num",
        *(vote(*(F.col(rating_column(r, v)) for r in raters)).alias(v) for v in variables),
    )


@query
def majority_strict(t: Tables) -> DataFrame:
    normal = ratings.with_model_majority(ratings.normalise_ratings(t.ratings))
    return normal.select("art_num", *(c for c in normal.columns if c.endswith("_llm_majority")))


@query
def vote_then_norm(t: Tables) -> DataFrame:
    return _votes(t, votes.vote_then_norm, [f"{r}_race" for r in ROLES], MODELS)


@query
def norm_then_vote(t: Tables) -> DataFrame:
    return _votes(t, votes.norm_then_vote, [f"{r}_race" for r in ROLES], MODELS)


@query
def all_agree(t: Tables) -> DataFrame:
    normal = ratings.normalise_ratings(t.ratings)
    columns = [F.col(rating_column(r, "crime_label")) for r in RATERS]
    return normal.select("art_num", votes.all_agree(*columns).alias("agree"))


RATIO_COLUMNS = ("ratio", "ci_lower", "ci_upper", "err_low", "err_high")


@query
def oe_ratio_ci(t: Tables) -> DataFrame:
    """Line items observed against the number expected, per supplier."""
    cells = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").cast("bigint").alias("observed"),
        F.sum(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("double"))
              .otherwise(0.0)).alias("expected"),
    )
    return rounded(series.with_oe_ratio_ci(cells), *RATIO_COLUMNS)


@query
def variable_labels(t: Tables) -> DataFrame:
    long = ratings.ratings_wide_to_long(t.ratings)
    return agreement.variable_labels(long).groupBy("variable").agg(F.count("value").alias("n"))


# --- joins --------------------------------------------------------------------


@query
def crawl_candidates(t: Tables) -> DataFrame:
    targets = crawl.crawl_targets(t.crawl_sources, YEARS)
    return crawl.crawl_candidates(targets, _index(t)).select(
        "source_id", "source", "year", "collection", "host", "variant_pos", "coll_pos", "url"
    )


@query
def collect_matched_articles(t: Tables) -> DataFrame:
    """Stage 1 from end to end."""
    return collect_articles(t.crawl_sources, _index(t), _pages(t), YEARS).select(
        "source", "state", "url", "year", joined("matched_keywords"), "text"
    )


@query
def articles_with_ideology(t: Tables) -> DataFrame:
    return series.articles_with_ideology(t.articles, t.sources).select(
        "doc_id", "domain", "ideology"
    )


@query
def people_with_ideology(t: Tables) -> DataFrame:
    return series.people_with_ideology(t.people, t.sources).select(
        "art_num", "l_linenumber", "l_partkey", "l_suppkey",
        "url_norm", "ideology", "ideology_label", "state",
    )


@query
def people_with_population(t: Tables) -> DataFrame:
    people = series.people_with_population(series.people_with_ideology(t.people, t.sources))
    return rounded(
        people.select(
            "art_num", "l_linenumber", "l_partkey", "l_suppkey",
            "state", "white_prop", "black_prop", "other_prop",
        ),
        "other_prop",
    )


@query
def region_lookup(t: Tables) -> DataFrame:
    return series.region_lookup(t.articles.select("doc_id", "state"))


@query
def human_pair(t: Tables) -> DataFrame:
    return ratings.human_pair(ratings.survey_question_map(t.sheets))


@query
def model_human_merge(t: Tables) -> DataFrame:
    models = ratings.model_ratings(t.people, F.col("row_idx"))
    humans = ratings.human_pair(ratings.survey_question_map(t.sheets))
    return ratings.model_human_merge(models, humans)


@query
def rater_pairs(t: Tables) -> DataFrame:
    """All pairs of all articles, counted per value pair with a sum over the articles."""
    pairs = agreement.rater_pairs(ratings.normalise_ratings(t.ratings))
    return pairs.groupBy(*agreement.PAIR, "value_1", "value_2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("art_num").alias("art_nums")
    )


@query
def resume_filter(t: Tables) -> DataFrame:
    collected = t.articles.where(F.col("year") <= 2018 + F.col("doc_id") % 5)
    targets = crawl.with_years(
        t.articles.select("doc_id", urls.url_netloc(F.col("url")).alias("domain")), YEARS
    )
    return crawl.resume_filter(targets, crawl.last_year_per_domain(collected))


# --- aggregations -------------------------------------------------------------


@query
def first_non_null(t: Tables) -> DataFrame:
    people = t.people
    return ratings.first_non_null(
        people, ["art_num"], ratings.model_columns(people), F.col("row_idx")
    )


def _sheets_from_survey(t: Tables) -> DataFrame:
    survey = t.survey
    answers = ratings.survey_key_parse(ratings.survey_unpivot(survey))
    return ratings.survey_pivot(answers, ratings.survey_questions(survey))


@query
def survey_pivot(t: Tables) -> DataFrame:
    return _sheets_from_survey(t)


@query
def curation_funnel(t: Tables) -> DataFrame:
    return curation.curation_funnel(t.articles)


@query
def curated_articles(t: Tables) -> DataFrame:
    """Stage 2 from end to end."""
    return curation.curate(t.articles).select(
        "doc_id", "url", "year", "source", "state",
        joined("tier1_keywords"), joined("tier2_keywords"), "text",
    )


@query
def last_year_per_domain(t: Tables) -> DataFrame:
    return crawl.last_year_per_domain(t.articles)


def _scores(t: Tables) -> DataFrame:
    return series.ideology_scores(t.articles, t.sources)


@query
def ideology_bin_counts(t: Tables) -> DataFrame:
    return series.ideology_bin_counts(_scores(t))


@query
def ideology_hist(t: Tables) -> DataFrame:
    return series.ideology_hist(_scores(t))


@query
def ideology_mean_median(t: Tables) -> DataFrame:
    return rounded(series.ideology_mean_median(_scores(t)), "mean", "median")


@query
def state_counts(t: Tables) -> DataFrame:
    return series.state_counts(t.articles)


@query
def region_counts(t: Tables) -> DataFrame:
    return series.region_counts(t.articles)


@query
def race_counts(t: Tables) -> DataFrame:
    return series.race_counts(t.people, t.sources)


@query
def race_rollup_all(t: Tables) -> DataFrame:
    return series.race_rollup_all(series.race_counts(t.people, t.sources))


@query
def race_oe(t: Tables) -> DataFrame:
    cells = series.with_oe_ratio_ci(series.race_oe(t.people, t.sources))
    return rounded(cells, "expected", *RATIO_COLUMNS)


@query
def cohen_kappa(t: Tables) -> DataFrame:
    return rounded(agreement.cohen_kappa(t.ratings, raw=True), "value")


@query
def nominal_alpha(t: Tables) -> DataFrame:
    """Alpha over all five raters at once."""
    return rounded(agreement.nominal_alpha(t.ratings, raw=True), "value")


@query
def nominal_alpha_pairs(t: Tables) -> DataFrame:
    irr = agreement.irr_table(t.ratings, digits=6, raw=True)
    return irr.where(F.col("variable").isin(*NOMINAL_VARIABLES)).drop("metric")


@query
def label_kappa(t: Tables) -> DataFrame:
    """Kappa of two real binary ratings."""
    table = t.labels.select(
        F.col("doc_id").alias("art_num"),
        F.col("quality").cast("string").alias("eleanor_crime_present"),
        F.col("toxic").cast("string").alias("sarah_crime_present"),
    )
    return rounded(agreement.cohen_kappa(table, raw=True), "value")


@query
def coincidence_matrix(t: Tables) -> DataFrame:
    return agreement.coincidence_matrix(t.ratings, raw=True)


@query
def pair_valid_n(t: Tables) -> DataFrame:
    return agreement.pair_valid_n(t.ratings, raw=True)


@query
def irr_table(t: Tables) -> DataFrame:
    return agreement.irr_table(t.ratings, raw=True)


@query
def irr_table_by_batches(t: Tables) -> DataFrame:
    """The table after four batches of articles, one of which is rated anew."""
    store, batch = scratch(t.spark, "agreement"), F.pmod("art_num", F.lit(3))
    for n in range(3):
        patterns = update_agreement(t.spark, t.ratings.where(batch == n), store, n + 1, raw=True)
    again = t.ratings.where(batch == 1)
    patterns = update_agreement(t.spark, again, store, 4, replaced=again, raw=True)
    return agreement.irr_table_of(patterns)


@query
def irr_human_only(t: Tables) -> DataFrame:
    return agreement.irr_human_only(irr_table(t))


@query
def irr_human_vs_model(t: Tables) -> DataFrame:
    return agreement.irr_human_vs_model(irr_table(t))


@query
def label_disagreements(t: Tables) -> DataFrame:
    return agreement.label_disagreements(
        ratings.normalise_ratings(t.ratings, ["crime_label"])
    )


# --- windows, sets, reshape -----------------------------------------------------


@query
def cap_per_source_year(t: Tables) -> DataFrame:
    return crawl.cap_per_source_year(t.matched)


@query
def race_share(t: Tables) -> DataFrame:
    rollup = series.race_rollup_all(series.race_counts(t.people, t.sources))
    return rounded(series.race_share(rollup), "proportion")


def _term_counts(t: Tables) -> DataFrame:
    """Articles per term found in them."""
    low = with_lowered(t.articles, "text")
    hits = compute_once(low, hits=hits_in_lowered("_lowered", TIER1_TERMS + TIER2_TERMS))
    return hits.select(F.explode("hits").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def keyword_union(t: Tables) -> DataFrame:
    """Every distinct term of both tiers with the number of articles that hold it."""
    terms = keyword_terms(t.spark)
    tier = {n: terms.where(F.col("tier") == n).select("term") for n in (1, 2)}
    union = tier[1].unionByName(tier[2]).distinct()
    return union.join(_term_counts(t), "term", "left").select(
        "term", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def hits_distinct(t: Tables) -> DataFrame:
    """Distinct terms per article, however often each occurs."""
    low = with_lowered(t.articles.select("doc_id", "text"), "text")
    hits = compute_once(low, hits=hits_in_lowered("_lowered", TIER2_TERMS * 2))
    return hits.select("doc_id", F.size("hits").alias("n_hits"))


@query
def survey_unpivot(t: Tables) -> DataFrame:
    return ratings.survey_unpivot(t.survey)


@query
def ratings_wide_to_long(t: Tables) -> DataFrame:
    return ratings.ratings_wide_to_long(t.ratings)
