"""Stage 3: agreement between human coders and models; who they are is the study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broadsheet.dims import STUDY, Study
from broadsheet.operators.agreement import irr_table, label_disagreements, merge_patterns, rating_patterns, retracted
from broadsheet.operators.ratings import human_ratings, model_human_merge, model_ratings
from broadsheet.sources.readers import read_people, read_survey_cells
from broadsheet.sources.writers import write_irr_tables


def merged_ratings(people: DataFrame, survey: DataFrame, study: Study = STUDY) -> DataFrame:
    """One normalised row per article that models and all humans rated."""
    models = model_ratings(people, F.col("row_pos"), study)
    return model_human_merge(models, human_ratings(survey, study))


def run_agreement(
    spark: SparkSession,
    people_path: str,
    survey_path: str,
    out: str,
    multi_line: bool = True,
    merged_count: Observation | None = None,
    study: Study = STUDY,
) -> DataFrame:
    """Write the three tables under ``out``; return the table of all pairs.

    ``merged_count``, if given, observes the number of ``articles`` that models
    and all humans rated, while they are written. With ``multi_line`` off every
    line of the people file is a row.
    """
    people = read_people(spark, people_path, multi_line)
    merged = merged_ratings(people, read_survey_cells(spark, survey_path), study)
    if merged_count is not None:
        merged = merged.observe(merged_count, F.count(F.lit(1)).alias("articles"))
    merged.write.mode("overwrite").parquet(f"{out}/ratings")
    ratings = spark.read.parquet(f"{out}/ratings")
    irr_table(ratings, study=study).write.mode("overwrite").parquet(f"{out}/irr")
    irr = spark.read.parquet(f"{out}/irr")
    write_irr_tables(irr, label_disagreements(ratings, study), out, study)
    return irr


def update_agreement(
    spark: SparkSession,
    ratings: DataFrame,
    store: str,
    batch: int,
    replaced: DataFrame | None = None,
    raw: bool = False,
    study: Study = STUDY,
) -> DataFrame:
    """Add a batch of rated articles to the pattern counts under ``store`` and return them.

    Batches are numbered from 1. Batch n reads the counts after batch n - 1 and its own
    articles alone, and writes counts of everything so far, a few rows per variable; it may
    run again. ``replaced`` holds former ratings of articles that are rated anew: their
    patterns are taken away. The tables follow by `irr_table_of`, `cohen_kappa_of` and
    `nominal_alpha_of`.
    """
    parts = [rating_patterns(ratings, raw=raw, study=study)]
    if replaced is not None:
        parts.append(retracted(rating_patterns(replaced, raw=raw, study=study)))
    if batch > 1:
        parts.append(spark.read.parquet(f"{store}/patterns/batch={batch - 1}"))
    path = f"{store}/patterns/batch={batch}"
    merge_patterns(*parts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
