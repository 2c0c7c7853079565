"""Keep dated articles that mention a required keyword."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import TIER1_TERMS, TIER2_TERMS
from broadsheet.functions.text import (
    any_in_lowered, compute_once, has_date, hits_in_lowered, strip, with_lowered,
)

KEPT, NO_DATE, NO_KEYWORD = "kept", "no_date", "no_keyword"


def terms_from_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Dictionary terms, one per line: lower case, blank lines dropped.

    Only line ends are cut off; other blanks around a term belong to it.
    """
    text = F.col(line)
    return lines.where(strip(text) != "").select(
        F.lower(F.rtrim(text, F.lit("\r\n"))).alias("term")
    )


def body_keyword_filter(
    articles: DataFrame, text: str = "text", tier1: Iterable[str] = TIER1_TERMS
) -> DataFrame:
    """Articles whose text holds a tier-1 term; tier 2 does not matter here."""
    low = with_lowered(articles, text)
    return low.where(any_in_lowered("_lowered", tier1)).drop("_lowered")


def curation_outcome(
    lowered: str, text: Column, tier1: Iterable[str] = TIER1_TERMS
) -> Column:
    """Why an article is dropped, or that it is kept. The date counts first."""
    return (
        F.when(~has_date(text), NO_DATE)
        .when(~any_in_lowered(lowered, tier1), NO_KEYWORD)
        .otherwise(KEPT)
    )


def with_outcome(
    articles: DataFrame, text: str = "text", tier1: Iterable[str] = TIER1_TERMS
) -> DataFrame:
    """Add ``outcome`` and the lower-case text ``_lowered``, each computed once."""
    low = with_lowered(articles, text)
    return compute_once(low, outcome=curation_outcome("_lowered", F.col(text), tier1))


def funnel_counts() -> list[Column]:
    outcome = F.col("outcome")
    return [F.count(F.lit(1)).alias("total")] + [
        F.count_if(outcome == name).alias(name) for name in (KEPT, NO_DATE, NO_KEYWORD)
    ]


def curation_funnel(
    articles: DataFrame, text: str = "text", tier1: Iterable[str] = TIER1_TERMS
) -> DataFrame:
    """One row: total, kept, no_date, no_keyword."""
    return with_outcome(articles, text, tier1).agg(*funnel_counts())


def curate(
    articles: DataFrame,
    text: str = "text",
    tier1: Iterable[str] = TIER1_TERMS,
    tier2: Iterable[str] = TIER2_TERMS,
) -> DataFrame:
    """Articles with a date and a tier-1 keyword, with the hits of both tiers.

    Narrow all the way: each article is read, tested and written in one task.
    """
    low = with_lowered(articles.where(has_date(F.col(text))), text)
    hits = compute_once(low, tier1_keywords=hits_in_lowered("_lowered", tier1))
    return (
        hits.where(F.size("tier1_keywords") > 0)
        .withColumn("tier2_keywords", hits_in_lowered("_lowered", tier2))
        .drop("_lowered")
    )


def keep_curated(
    judged: DataFrame,
    tier1: Iterable[str] = TIER1_TERMS,
    tier2: Iterable[str] = TIER2_TERMS,
) -> DataFrame:
    """`curate` for rows that already carry an outcome (see `with_outcome`)."""
    return (
        judged.where(F.col("outcome") == KEPT)
        .withColumns(
            {
                "tier1_keywords": hits_in_lowered("_lowered", tier1),
                "tier2_keywords": hits_in_lowered("_lowered", tier2),
            }
        )
        .drop("_lowered", "outcome")
    )


def header_normalise(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case."""
    return df.toDF(*(name.strip().lower() for name in df.columns))
