"""Stage 4: the data series behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.dims import STUDY, Study
from broadsheet.operators.series import (
    ideology_bin_counts, ideology_hist, ideology_mean_median, ideology_scores, race_counts,
    race_oe, race_rollup_all, race_share, region_counts, state_counts, with_oe_ratio_ci,
)
from broadsheet.sources.readers import (
    read_curated_metadata, read_people, read_race_counts, read_sources,
)
from broadsheet.sources.writers import write_race_counts, write_series


def article_series(articles: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    scores = ideology_scores(articles, sources)
    return {
        "ideology_bins": ideology_bin_counts(scores),
        "ideology_histogram": ideology_hist(scores),
        "ideology_mean_median": ideology_mean_median(scores),
        "articles_per_state": state_counts(articles),
        "articles_per_region": region_counts(articles),
    }


def run_figures(
    spark: SparkSession,
    metadata_path: str,
    sources_path: str,
    people_path: str,
    out: str,
    multi_line: bool = True,
    study: Study = STUDY,
) -> list[str]:
    """Write every series under ``out``; return their names.

    Turn ``multi_line`` off if no cell holds a line break: files are then split
    between tasks.
    """
    sources = read_sources(spark, sources_path, multi_line)
    people = read_people(spark, people_path, multi_line)
    metadata = read_curated_metadata(spark, metadata_path, multi_line)
    series = article_series(metadata, sources)
    write_race_counts(race_counts(people, sources, study), f"{out}/race_counts.csv")
    counts = read_race_counts(spark, f"{out}/race_counts.csv")
    series["race_shares"] = race_share(race_rollup_all(counts))
    series["race_representation"] = with_oe_ratio_ci(race_oe(people, sources, study))
    for name, df in series.items():
        write_series(df, f"{out}/{name}.csv")
    return sorted(series)
