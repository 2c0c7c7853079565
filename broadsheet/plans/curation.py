"""Stage 2: the curated articles and why the others were dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from broadsheet.dims import TIER1_TERMS, TIER2_TERMS, constant_table
from broadsheet.operators.curation import funnel_counts, keep_curated, with_outcome
from broadsheet.operators.dictionary import curate_by_dictionaries
from broadsheet.sources.readers import load_terms, read_article_blocks, read_terms
from broadsheet.sources.writers import write_article_blocks, write_curated_metadata


PLAN_TERMS = 2000


def _terms(spark: SparkSession, path: str | None, known: tuple[str, ...]) -> tuple[str, ...] | DataFrame:
    """The list in a file, or its table if it is long; the known list without a file."""
    if not path:
        return known
    listed = read_terms(spark, path)
    return listed if listed.limit(PLAN_TERMS + 1).count() > PLAN_TERMS else load_terms(spark, path)


def run_curation(
    spark: SparkSession,
    in_path: str,
    out: str,
    newline: str = "\n",
    tier1_path: str | None = None,
    tier2_path: str | None = None,
) -> dict[str, int]:
    """Write curated articles under ``out``; return the funnel counts.

    The counts are observed while the articles are written, in the same pass.
    Keyword files, if given, replace the built-in lists. Lists of up to PLAN_TERMS terms
    become part of the plan; longer ones are joined by a gram index.
    """
    funnel = Observation("curation_funnel")
    articles = read_article_blocks(spark, in_path, newline)
    lists = [_terms(spark, tier1_path, TIER1_TERMS), _terms(spark, tier2_path, TIER2_TERMS)]
    if any(isinstance(terms, DataFrame) for terms in lists):
        tables = [t if isinstance(t, DataFrame) else constant_table(spark, "term", [(x,) for x in t or ("",)]) for t in lists]
        curated = curate_by_dictionaries(articles, *tables, observation=funnel)
    else:
        tier1, tier2 = lists
        judged = with_outcome(articles, tier1=tier1).observe(funnel, *funnel_counts())
        curated = keep_curated(judged, tier1, tier2)
    curated.write.mode("overwrite").parquet(f"{out}/articles")
    curated = spark.read.parquet(f"{out}/articles")
    write_article_blocks(curated, f"{out}/filtered_articles.txt", "overwrite")
    write_curated_metadata(curated, f"{out}/filtered_metadata.csv")
    return funnel.get
