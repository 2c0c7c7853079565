"""Reshape, normalise and merge human and model annotations."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.dims import (
    SURVEY_FIRST_ANSWER, SURVEY_QUESTIONS, STUDY, VARIABLES, Study,
)
from broadsheet.functions.labels import model_column_normaliser, normaliser_for
from broadsheet.functions.text import compute_once, stacked
from broadsheet.functions.votes import majority_strict


def _named(name: str) -> Column:
    """A column by its literal name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def model_columns(df: DataFrame, study: Study = STUDY) -> list[str]:
    return [c for c in df.columns if c.split("_")[0] in study.models and "_" in c]


def first_non_null(
    df: DataFrame, keys: list[str], columns: list[str], position: Column
) -> DataFrame:
    """Per group and column, the first value there is, in order of ``position``.

    A partial aggregate: map tasks send one row per group, whatever its size.
    """
    read = map(_named, [*keys, *columns, "_position"])
    placed = compute_once(df, _position=position).select(*read)
    firsts = [
        F.min_by(_named(c), F.when(_named(c).isNotNull(), F.col("_position"))).alias(c)
        for c in columns
    ]
    return placed.groupBy(*map(_named, keys)).agg(*firsts)


def model_ratings(people: DataFrame, position: Column, study: Study = STUDY) -> DataFrame:
    """One normalised row per article from one row per person."""
    columns = model_columns(people, study)
    first = first_non_null(people, ["art_num"], columns, position)
    return first.select(
        "art_num",
        *(
            (model_column_normaliser(c, study) or (lambda v: v))(_named(c)).alias(c)
            for c in columns
        ),
    )


def normalise_ratings(ratings: DataFrame, variables: Iterable[str] = VARIABLES, study: Study = STUDY) -> DataFrame:
    """Apply to every rating column of the variables its normaliser.

    The columns of a variable are normalised as one array: the expression is
    there once instead of once per rater, and its result is not recomputed by
    whatever uses the columns next.
    """
    places, arrays = {}, {}
    for v in variables:
        columns = [c for c in (study.column(r, v) for r in study.raters) if c in ratings.columns]
        if columns:
            places |= {c: F.get(f"_{v}", F.lit(i)).alias(c) for i, c in enumerate(columns)}
            arrays[f"_{v}"] = F.transform(F.array(*columns), normaliser_for(v))
    return compute_once(ratings, **arrays).select(*(places.get(c, c) for c in ratings.columns))


# --- survey export ------------------------------------------------------------

_ANSWER_COLUMN = re.compile(r"ART\d{4}_Q")
_ARTICLE_PREFIX = re.compile(r"ART\d+_")


def survey_answer_columns(survey: DataFrame) -> list[str]:
    return [c for c in survey.columns if _ANSWER_COLUMN.match(c)]


def answered_rows(survey: DataFrame) -> DataFrame:
    """Rows of real respondents: the first answer is there and is no template."""
    first = F.col(SURVEY_FIRST_ANSWER)
    return survey.where(first.isNotNull() & ~F.startswith(first, F.lit("{")))


def survey_respondents(survey: DataFrame, position: str = "row_pos", study: Study = STUDY) -> DataFrame:
    """Answered rows, named after the human raters by position.

    There is one row per human rater; more are an error. The test is a filter over the
    count, so no projection can prune it away, and it fails before rows are numbered.
    """
    answered = answered_rows(survey)
    count = answered.agg(F.count("*").alias("_respondents"))  # one row
    fits = F.when(F.col("_respondents") <= len(study.humans), True).otherwise(
        F.raise_error(F.lit("more survey rows than raters")).cast("boolean"))
    checked = answered.join(F.broadcast(count), how="cross").where(fits).drop("_respondents")
    names = F.array(*(F.lit(h.capitalize()) for h in study.humans))
    number = F.row_number().over(Window.orderBy(position))
    return checked.withColumn("rater", F.get(names, number - 1)).drop(position)


def survey_unpivot(survey: DataFrame, ids: tuple[str, ...] = ("rater",)) -> DataFrame:
    """Wide answers to long ``(rater, col, value)``; missing answers stay rows."""
    columns = survey_answer_columns(survey)
    if not columns:
        return survey.select(*map(_named, ids), F.lit("").alias("col"), F.lit("").alias("value")).where("false")
    # By position: one array a row and one list of names, however many columns there are.
    answers = F.expr("array(" + ", ".join("`" + c.replace("`", "``") + "`" for c in columns) + ")")
    names = F.split(F.lit("\n".join(columns)), "\n")
    spread = survey.select(*map(_named, ids), F.posexplode(answers).alias("_at", "value"))
    return spread.select(*map(_named, ids), F.get(names, F.col("_at")).alias("col"), "value")


def survey_answers(cells: DataFrame, study: Study = STUDY) -> DataFrame:
    """Cells of survey exports to long ``(file_pos, rater, col, value)``, whatever their width.

    The long form of `survey_respondents` and `survey_unpivot`: rows are kept by their
    first answer, at most one per human rater and file, and raters are named by position.
    """
    first = cells.where(F.col("col") == SURVEY_FIRST_ANSWER).where("value IS NOT NULL AND NOT startswith(value, '{')")
    in_file = Window.partitionBy("file_pos")
    counted = first.select("file_pos", "row_pos", F.count("*").over(in_file).alias("_respondents"))
    fits = F.when(F.col("_respondents") <= len(study.humans), True).otherwise(
        F.raise_error(F.lit("more survey rows than raters")).cast("boolean"))
    names = F.array(*(F.lit(h.capitalize()) for h in study.humans))
    number = F.row_number().over(in_file.orderBy("row_pos"))
    raters = counted.where(fits).select("file_pos", "row_pos", F.get(names, number - 1).alias("rater"))
    answers = cells.where(F.col("col").rlike("^" + _ANSWER_COLUMN.pattern)).drop("file_pos")
    return answers.join(raters, "row_pos").select("file_pos", "rater", "col", "value")


def survey_key_parse(answers: DataFrame) -> DataFrame:
    """Split ``ART0007_Q1_…`` into article number and question."""
    col = F.col("col")
    return answers.withColumns(
        {
            "art_num": F.regexp_extract(col, r"ART(\d+)", 1).cast("int"),
            "question": F.regexp_replace(col, r"ART\d+_", ""),
        }
    )


def survey_questions(survey: DataFrame) -> list[str]:
    return sorted({_ARTICLE_PREFIX.sub("", c) for c in survey_answer_columns(survey)})


def survey_pivot(answers: DataFrame, questions: list[str]) -> DataFrame:
    """One row per rater and article that has any answer, one column per question."""
    return (
        answers.where(F.col("value").isNotNull())
        .groupBy("rater", "art_num")
        .pivot("question", questions)
        .agg(F.min_by("value", "col"))
    )


def survey_question_map(sheets: DataFrame) -> DataFrame:
    """Answer sheets with the questions renamed to variables and normalised.

    A variable takes the first question, by name, that contains its text.
    """
    names = sorted(c for c in sheets.columns if c not in ("rater", "art_num"))
    out = []
    for variable, text in SURVEY_QUESTIONS.items():
        match = next((n for n in names if text.lower() in n.lower()), None)
        if match is not None:
            out.append(normaliser_for(variable)(_named(match)).alias(variable))
    return sheets.select("rater", "art_num", *out)


def human_pair(sheets: DataFrame, raters: tuple[str, ...] = STUDY.humans) -> DataFrame:
    """One row per article coded by all humans, columns ``<rater>_<variable>``.

    One grouping instead of a self-join: sheets are unique per rater and article.
    """
    variables = [v for v in VARIABLES if v in sheets.columns]
    who = F.lower("rater")
    values = [
        F.max(F.when(who == r, F.col(v))).alias(f"{r}_{v}")
        for r in raters
        for v in variables
    ]
    coded = [F.count_if(who == r).alias(f"_{r}") for r in raters]
    both = sheets.groupBy("art_num").agg(*values, *coded)
    for r in raters:
        both = both.where(F.col(f"_{r}") > 0).drop(f"_{r}")
    return both


def human_ratings(survey: DataFrame, study: Study = STUDY) -> DataFrame:
    """Survey export, as a wide sheet or as cells, to one row per article coded by all humans."""
    if {"file_pos", "row_pos", "col", "value"} <= set(survey.columns):
        answers = survey_key_parse(survey_answers(survey, study))
        names = (F.regexp_replace("col", _ARTICLE_PREFIX.pattern, "")).alias("question")
        asked = survey.where(F.col("col").rlike("^" + _ANSWER_COLUMN.pattern)).select(names).distinct()
        questions = sorted(r.question for r in asked.collect())  # a few: articles share their questions
    else:
        answers = survey_key_parse(survey_unpivot(survey_respondents(survey, study=study)))
        questions = survey_questions(survey)
    return human_pair(survey_question_map(survey_pivot(answers, questions)), study.humans)


def model_human_merge(models: DataFrame, humans: DataFrame) -> DataFrame:
    """Articles rated by models and humans; both sides are unique per article."""
    return models.join(humans, "art_num")


def ratings_wide_to_long(ratings: DataFrame, study: Study = STUDY) -> DataFrame:
    """``(art_num, variable, rater, value)`` for every rating column present."""
    cells = [
        f"'{v}', '{r}', {study.column(r, v)}"
        for v in VARIABLES
        for r in study.raters
        if study.column(r, v) in ratings.columns
    ]
    return ratings.select("art_num", stacked(cells, ["variable", "rater", "value"]))


def with_model_majority(ratings: DataFrame, study: Study = STUDY) -> DataFrame:
    """Add ``<variable>_llm_majority`` where at least two models rated the variable."""

    def add(df: DataFrame, variable: str) -> DataFrame:
        columns = [
            c for c in (study.column(m, variable) for m in study.models) if c in ratings.columns
        ]
        if len(columns) < 2:
            return df
        return df.withColumn(
            f"{variable}_llm_majority", majority_strict(*map(F.col, columns))
        )

    return reduce(add, VARIABLES, ratings)
