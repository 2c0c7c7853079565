"""From sources and a crawl index to matched article texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.dims import (
    MAX_PER_SOURCE_YEAR, MIN_CHARS, TIER1_TERMS, TIER2_TERMS, collections_of, crawl_collections,
    parse_years,
)
from broadsheet.functions.html import html_text
from broadsheet.functions.text import (
    any_in_lowered, compute_once, hits_in_lowered, min_chars, with_lowered,
)
from broadsheet.functions.urls import domain_variants, url_host, url_netloc

ALL_TERMS = TIER1_TERMS + TIER2_TERMS


def complete_sources(sources: DataFrame) -> DataFrame:
    """Sources that have all four of name, state, city and URL."""
    return sources.na.drop("any", subset=["name", "state", "city", "URL"])


def with_years(sources: DataFrame, years: str) -> DataFrame:
    """One row per source and year of ``"2019"`` or ``"2018-2024"``."""
    listed = F.array(*(F.lit(y) for y in parse_years(years)))
    return sources.withColumn("year", F.explode(listed))


def with_variants(targets: DataFrame) -> DataFrame:
    """One row per host name to look up: adds ``variant_pos`` and ``host``."""
    return targets.select(
        "*", F.posexplode(domain_variants(F.col("domain"))).alias("variant_pos", "host")
    )


def last_year_per_domain(articles: DataFrame) -> DataFrame:
    """Last collected year per domain of the article URLs."""
    return articles.groupBy(url_netloc(F.col("url")).alias("domain")).agg(
        F.max("year").alias("last_year")
    )


def resume_filter(targets: DataFrame, last_years: DataFrame) -> DataFrame:
    """Drop (domain, year) targets up to the last year collected for the domain."""
    done = last_years.select(F.col("domain").alias("_done"), F.col("last_year").alias("_until"))
    return targets.join(
        done,
        (targets["domain"] == done["_done"]) & (targets["year"] <= done["_until"]),
        "left_anti",
    )


def crawl_targets(
    sources: DataFrame, years: str, last_years: DataFrame | None = None
) -> DataFrame:
    """Host and collection of every lookup a crawl makes.

    Years without a collection yield nothing. ``sources`` needs ``source_id``.
    """
    targets = with_years(
        complete_sources(sources).select(
            "source_id",
            F.col("name").alias("source"),
            "state",
            url_netloc(F.col("URL")).alias("domain"),
        ),
        years,
    )
    if last_years is not None:
        targets = resume_filter(targets, last_years)
    collections = F.broadcast(crawl_collections(sources.sparkSession))  # 14 rows
    return with_variants(targets).join(collections, "year")


def url_keyword_filter(
    df: DataFrame, url: str = "url", terms: Iterable[str] = ALL_TERMS
) -> DataFrame:
    """Rows whose URL holds a term of either tier."""
    low = with_lowered(df, url)
    return low.where(any_in_lowered("_lowered", terms)).drop("_lowered")


def with_matched_keywords(
    df: DataFrame, url: str = "url", terms: Iterable[str] = ALL_TERMS
) -> DataFrame:
    low = with_lowered(df, url)
    return low.withColumn(
        "matched_keywords", hits_in_lowered("_lowered", terms)
    ).drop("_lowered")


def of_years(index: DataFrame, years: str) -> DataFrame:
    """Index records in the collections of the years; folders of other collections are not read."""
    return index.where(F.col("collection").isin(*collections_of(years)))


def of_hosts(index: DataFrame, hosts: Iterable[str]) -> DataFrame:
    """Records of a few hosts. In a table sorted by host, row groups without them are skipped."""
    return index.where(F.col("host").isin(*hosts))


def crawl_candidates(targets: DataFrame, index: DataFrame) -> DataFrame:
    """Index records on the targets' hosts, in the targets' collections.

    A record found through several variants or collections is kept each time.
    The join is left to the optimizer: an inventory of sources is broadcast by
    its size, a large one is shuffled, with skewed hosts split at run time.
    """
    records = index.where(F.col("url").isNotNull())
    if "host" not in records.columns:
        records = records.withColumn("host", url_host(F.col("url")))
    return records.join(targets, ["host", "collection"])


PAGE_KEY = ("filename", "offset")
BROADCAST_KEYS = 500_000  #: page keys of about 100 bytes


def store_page_table(pages: DataFrame, name: str, buckets: int, on: tuple[str, ...] = PAGE_KEY) -> None:
    """Save pages as a table bucketed by their key, so that finding pages never shuffles their html."""
    pages.write.mode("overwrite").bucketBy(buckets, *on).saveAsTable(name)


def by_page_key(keys: DataFrame, wide: DataFrame, n_keys: int, on: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Join a narrow table of keys to wide rows without sorting the wide ones.

    Up to BROADCAST_KEYS keys are sent to where the wide rows are. More are hashed by
    partition, into which the wide rows stream; those of a table bucketed by the key stay
    where they are. The key names one stored page, so it is not skewed.
    """
    small = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys.hint("shuffle_hash")
    return wide.join(small, list(on))


def page_texts(
    candidates: DataFrame, pages: DataFrame, n_keys: int, limit: int = MIN_CHARS,
    on: tuple[str, ...] = PAGE_KEY,
) -> DataFrame:
    """Key and text of every page that some candidate needs and that has text enough, parsed once."""
    wanted = candidates.select(*on).distinct()
    return extract_articles(by_page_key(wanted, pages.select(*on, "html"), n_keys, on), limit).select(*on, "text")


def fetch_pages(
    candidates: DataFrame, pages: DataFrame, on: tuple[str, ...] = PAGE_KEY
) -> DataFrame:
    """Add the page of each record. The key names one stored page, so it is not skewed."""
    return candidates.join(pages.select(*on, "html"), list(on))


def extract_articles(pages: DataFrame, limit: int = MIN_CHARS) -> DataFrame:
    """Replace ``html`` by its text and drop pages with too little of it."""
    texts = compute_once(pages, text=html_text(F.col("html"), limit)).drop("html")
    return texts.where(min_chars(F.col("text"), limit))


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64
) -> DataFrame:
    """First ``k`` rows of every group.

    Ranked within salted sub-groups first: however large a group is, no task
    sees more of it than one sub-group, and then ``k`` rows of each sub-group.
    Rows of one task share a salt. The rank is limited ahead of its shuffle, so
    each task sends at most ``k`` rows of a group. The result does not depend on
    the salts.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    for partition in ([*keys, "_salt"], keys):
        window = Window.partitionBy(*partition).orderBy(*order)
        salted = salted.withColumn("_rank", F.row_number().over(window))
        salted = salted.where(F.col("_rank") <= k).drop("_rank")
    return salted.drop("_salt")


def lookup_order() -> list[Column]:
    return [F.col("variant_pos"), F.col("coll_pos"), F.col("index_pos")]


def cap_per_source_year(articles: DataFrame, k: int = MAX_PER_SOURCE_YEAR) -> DataFrame:
    """First ``k`` articles of each source row and year, in lookup order."""
    return top_per_group(articles, ["source_id", "year"], lookup_order(), k)


def cap_after(articles: DataFrame, taken: DataFrame, k: int = MAX_PER_SOURCE_YEAR) -> DataFrame:
    """`cap_per_source_year` where ``taken`` has the number ``n`` of articles kept before."""
    keys = ["source_id", "year"]
    first = cap_per_source_year(articles, k)  # k rows of a group at most
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*lookup_order())))
    counted = ranked.join(taken.select(*keys, F.col("n").alias("_taken")), keys, "left")
    return counted.where(F.col("_rank") + F.coalesce("_taken", F.lit(0)) <= k).drop("_rank", "_taken")
