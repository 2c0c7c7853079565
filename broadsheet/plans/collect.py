"""Stage 1: matched article texts from a crawl index and its pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.crawl import (
    ALL_TERMS, PAGE_KEY, by_page_key, cap_per_source_year, crawl_candidates, crawl_targets,
    last_year_per_domain, of_years, page_texts, url_keyword_filter, with_matched_keywords,
)
from broadsheet.sources.readers import load_terms, read_crawl_index, read_sources
from broadsheet.sources.writers import write_article_blocks, write_keyword_matches
from broadsheet.storage import stored


def collect_articles(
    sources: DataFrame,
    index: DataFrame,
    pages: DataFrame,
    years: str,
    collected: DataFrame | None = None,
    terms: Iterable[str] = ALL_TERMS,
) -> DataFrame:
    """``source, state, url, year, matched_keywords, text``.

    The URL test runs on the index scan, so only matching records are joined. A page
    is found by its file and offset alone; its own URL may be missing or another
    one after a redirect. Texts are extracted for pages of known sources alone.

    Texts join in last. Candidates, which are keys, are written to the shared folder; each
    page that they need is parsed once and the texts that are long enough are written
    too. Articles are ranked and capped by keys alone, and only those kept get their text.
    """
    last_years = None if collected is None else last_year_per_domain(collected)
    targets = crawl_targets(sources, years, last_years)
    candidates = stored_candidates(targets, of_years(index, years), terms)
    return articles_of(candidates, pages, terms).select("source", "state", "url", "year", "matched_keywords", "text")


def stored_candidates(targets: DataFrame, index: DataFrame, terms: Iterable[str] = ALL_TERMS) -> DataFrame:
    """Matching index records of the targets, in the shared folder."""
    found = crawl_candidates(targets, url_keyword_filter(index, terms=terms))
    return stored(found.select(
        "source_id", "source", "state", "url", "year", "variant_pos", "coll_pos", "index_pos", *PAGE_KEY), "candidates")


def articles_of(
    candidates: DataFrame,
    pages: DataFrame,
    terms: Iterable[str] = ALL_TERMS,
    cap: Callable[[DataFrame], DataFrame] = cap_per_source_year,
) -> DataFrame:
    """Capped articles of stored candidates, with their keys, keywords and text."""
    n_keys = candidates.count()
    texts = stored(page_texts(candidates, pages, n_keys), "texts")
    capped = cap(by_page_key(texts.select(*PAGE_KEY), candidates, n_keys))
    articles = by_page_key(capped.select("source_id", "source", "state", "url", "year", *PAGE_KEY), texts, n_keys)
    return with_matched_keywords(articles, terms=terms)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Batches(NamedTuple):
    """What the log under an output folder tells."""

    complete: list[int]  #: batches whose outputs are all written and count
    last: int  #: number of the last batch begun; 0 before the first
    broken: bool  #: the last batch was begun and never finished


def batches(spark: SparkSession, out: str) -> Batches:
    log = _stored(spark, f"{out}/log")
    rows = [] if log is None else log.collect()  # two narrow rows per run
    done = {r.batch: r.first for r in rows if r.done}
    first = max(done.values(), default=0)
    last = max((r.batch for r in rows), default=0)
    return Batches(sorted(b for b in done if b >= first), last, last not in done and last > 0)


def _log(spark: SparkSession, out: str, batch: int, first: int, done: bool) -> None:
    row = spark.createDataFrame([(batch, first, done)], "batch int, first int, done boolean")
    row.coalesce(1).write.mode("append").parquet(f"{out}/log")


def collected_so_far(spark: SparkSession, out: str) -> DataFrame | None:
    """Articles of the complete batches under ``out``, if there are any."""
    complete = batches(spark, out).complete
    if not complete:
        return None
    return spark.read.parquet(f"{out}/articles").where(F.col("batch").isin(complete)).drop("batch")


def _write_texts(articles: DataFrame, out: str, mode: str) -> None:
    write_article_blocks(articles, f"{out}/matched_articles.txt", mode)
    write_keyword_matches(articles, f"{out}/keyword_matches.csv", mode)


def _repair(spark: SparkSession, out: str, complete: list[int]) -> None:
    """Rewrite both text outputs without what an unfinished batch left in them."""
    articles = _stored(spark, f"{out}/articles")
    if articles is not None:
        _write_texts(articles.where(F.col("batch").isin(complete)), out, "overwrite")


def run_collect(
    spark: SparkSession,
    sources_path: str,
    index_path: str,
    pages_path: str,
    years: str,
    out: str,
    resume: bool = True,
    multi_line: bool = True,
    term_paths: Iterable[str] = (),
) -> DataFrame:
    """Collect a batch of articles into ``out`` and return it.

    With ``resume``, years that complete batches hold for a domain are left out
    and the batch is added to them; without, it takes their place. A batch has a
    number and a Parquet folder of its own; both text outputs are made from that,
    and the log says last that it is complete. What a run that died left behind
    is not counted as collected, and the next run takes it out of the texts.
    Keyword files, if given, replace the built-in lists.
    """
    known = batches(spark, out)
    if known.broken:
        _repair(spark, out, known.complete)
    terms = [t for p in term_paths for t in load_terms(spark, p)] or ALL_TERMS
    number = known.last + 1
    first = (known.complete or [number])[0] if resume else number
    _log(spark, out, number, first, False)
    path = f"{out}/articles/batch={number}"
    collect_articles(
        read_sources(spark, sources_path, multi_line),
        read_crawl_index(spark, index_path),
        spark.read.parquet(pages_path),
        years,
        collected_so_far(spark, out) if resume else None,
        terms,
    ).write.mode("overwrite").parquet(path)
    batch = spark.read.parquet(path)
    _write_texts(batch, out, "append" if resume else "overwrite")
    _log(spark, out, number, first, True)
    return batch
