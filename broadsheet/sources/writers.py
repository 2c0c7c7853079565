"""Writers. Outputs are folders of part files, each complete in itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import STUDY, Study
from broadsheet.functions.urls import url_host
from broadsheet.operators.agreement import irr_human_only, irr_human_vs_model
from broadsheet.sources.readers import BLOCK_FIELDS

METADATA_COLUMNS = ("url", "year", "source", "state", "tier1_keywords", "tier2_keywords")
# Cells are written as they are, with quotes doubled; blanks at the ends matter.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
KEYWORD_COLUMNS = ("tier1_keywords", "tier2_keywords")


def write_crawl_index(index: DataFrame, path: str, files: int, rows_per_group: int = 100_000) -> None:
    """Index records as a Parquet table that scans of some years or hosts read in part.

    A folder per collection; within it, files of disjoint host ranges, sorted by host, so
    that the least and greatest host of each row group tell whether it has to be read.
    """
    keyed = index.withColumn("host", url_host(F.col("url")))
    (keyed.repartitionByRange(files, "collection", "host", "index_pos").sortWithinPartitions("collection", "host", "index_pos")
     .write.mode("overwrite").partitionBy("collection").option("parquet.block.row.count.limit", rows_per_group).parquet(path))


def _text_of(df: DataFrame, name: str) -> Column:
    """A field as text, arrays joined by semicolons, missing as ``''``."""
    field = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        field = F.array_join(field, ";")
    return F.coalesce(field.cast("string"), F.lit(""))


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).csv(path, **CSV_OPTIONS)


def article_blocks(articles: DataFrame) -> DataFrame:
    """One text block per article; keyword lines only if the columns are there."""
    fields = BLOCK_FIELDS + tuple(c for c in KEYWORD_COLUMNS if c in articles.columns)
    lines = [F.concat(F.lit(f"{name}: "), _text_of(articles, name)) for name in fields]
    return articles.select(
        F.concat_ws(
            "\n", F.lit("---"), *lines, F.lit("text:"), _text_of(articles, "text"), F.lit("")
        ).alias("value")
    )


def write_article_blocks(articles: DataFrame, path: str, mode: str = "append") -> None:
    """Collected articles are appended, curated ones overwrite."""
    article_blocks(articles).write.mode(mode).text(path)


def keyword_matches(matched: DataFrame) -> DataFrame:
    return matched.select(
        "source", "state", "url", "year",
        _text_of(matched, "matched_keywords").alias("matched_keywords"),
    )


def write_keyword_matches(matched: DataFrame, path: str, mode: str = "append") -> None:
    _write_csv(keyword_matches(matched), path, mode)


def curated_metadata(curated: DataFrame) -> DataFrame:
    return curated.select(*(_text_of(curated, c).alias(c) for c in METADATA_COLUMNS))


def write_curated_metadata(curated: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write_csv(curated_metadata(curated), path, mode)


def write_irr_tables(irr: DataFrame, disagreements: DataFrame, folder: str, study: Study = STUDY) -> None:
    """Human pairs, human-model pairs and the disagreements, one folder each."""
    _write_csv(irr_human_only(irr, study), f"{folder}/irr_human_only.csv", "overwrite")
    _write_csv(irr_human_vs_model(irr, study), f"{folder}/irr_human_vs_llm.csv", "overwrite")
    _write_csv(disagreements, f"{folder}/crime_label_disagreements.csv", "overwrite")


def write_race_counts(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write_csv(counts.select("role", "race", "ideology", "count"), path, mode)


def write_series(series: DataFrame, path: str) -> None:
    _write_csv(series, path, "overwrite")
