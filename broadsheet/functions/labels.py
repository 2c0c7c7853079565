"""Label normalisers.

There are three race normalisers and they are not interchangeable: agreement
(`norm_race_irr`), observed/expected ratios (`norm_race_oe`) and race counts
(`norm_race_counts`) treat unknown and multiple answers differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.dims import BINARY_VARIABLES, CSV_MISSING, STUDY, Study
from broadsheet.functions.text import strip

# Answers and how they are read.
_EMPTY = ("", "nan", "none")
_YES = ("yes", "true", "1")
_NO = ("no", "false", "0")
_MINOR_RACES = (
    "hispanic", "asian", "middle eastern", "pacific islander",
    "native american", "native",
)
_NO_RACE = ("no name provided", "multiple", "unknown", "not_provided", "not provided")
_NO_GENDER = (
    "no name provided", "multiple", "not_provided", "not provided", "nonbinary/other",
)
_NO_RACE_OE = ("", "not_provided", "unknown")
_NO_RACE_COUNTS = ("", "not_provided", "unknown", "not provided", "multiple")
_NO_RACE_SERIES = ("not provided", "not_provided", "none", "")


def csv_missing_to_null(value: Column) -> Column:
    """Null out the cell texts that stand for a missing value."""
    return F.when(~value.isin(*CSV_MISSING), value)


def folded(value: Column) -> Column:
    """Stripped lower-case form in which all answers are compared."""
    return F.lower(strip(value))


def norm_label(value: Column) -> Column:
    low = folded(value)
    return F.when(~low.isin(*_EMPTY), low)


def norm_yes_no(value: Column) -> Column:
    low = folded(value)
    return F.when(low.isin(*_YES), "yes").when(low.isin(*_NO), "no")


def norm_race_irr(value: Column) -> Column:
    """Small groups become ``other``; unknown or multiple is no answer."""
    low = folded(value)
    return F.when(low.isin(*_MINOR_RACES), "other").when(
        ~low.isin(*_EMPTY, *_NO_RACE), low
    )


def norm_gender_irr(value: Column) -> Column:
    """``unknown`` stays a category of its own."""
    low = folded(value)
    return F.when(~low.isin(*_EMPTY, *_NO_GENDER), low)


def _three_races(low: Column, missing: tuple[str, ...]) -> Column:
    return F.when(low.isin("white", "black"), low).when(~low.isin(*missing), "other")


def race_class_oe(low: Column) -> Column:
    """`norm_race_oe` for an answer that is already stripped and lower case."""
    return _three_races(low, _NO_RACE_OE)


def norm_race_oe(value: Column) -> Column:
    """white, black or other; ``multiple`` and ``not provided`` are ``other``."""
    return race_class_oe(folded(value))


def norm_race_counts(value: Column) -> Column:
    """white, black or other; ``multiple`` and ``not provided`` are no answer."""
    return _three_races(folded(value), _NO_RACE_COUNTS)


def race_series_label(value: Column) -> Column:
    """Race as charted; a missing race shows up under the text ``nan``."""
    return folded(F.coalesce(value, F.lit("nan")))


def is_charted_race(label: Column) -> Column:
    return ~label.isin(*_NO_RACE_SERIES)


def normaliser_for(variable: str):
    """The normaliser an agreement variable goes through."""
    if variable in BINARY_VARIABLES:
        return norm_yes_no
    if variable.endswith("_race"):
        return norm_race_irr
    if variable.endswith("_gender"):
        return norm_gender_irr
    return norm_label


def normalise_by_variable(variable: Column, value: Column) -> Column:
    """An answer in long form, normalised as its variable asks for."""
    return (
        F.when(variable.isin(*BINARY_VARIABLES), norm_yes_no(value))
        .when(F.endswith(variable, F.lit("_race")), norm_race_irr(value))
        .when(F.endswith(variable, F.lit("_gender")), norm_gender_irr(value))
        .otherwise(norm_label(value))
    )


def model_column_normaliser(column: str, study: Study = STUDY):
    """Normaliser for a model's column, chosen by name; None leaves it as it is."""
    if column.split("_")[0] not in study.models:
        return None
    if any(v in column for v in BINARY_VARIABLES):
        return norm_yes_no
    if "_race" in column:
        return norm_race_irr
    if "_gender" in column:
        return norm_gender_irr
    return norm_label if "_crime" in column else None
