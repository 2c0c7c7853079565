"""Inter-rater agreement from counted answer patterns.

Every article is one wide row, so its raters meet within the row. The five
answers to a variable, one per rater, form a pattern; patterns are counted first, in the map
tasks, and all that follows works on those few rows: normalising raw answers,
forming pairs, and the sums behind kappa and alpha.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import (
    BINARY_VARIABLES, STUDY, VARIABLES, Study, constant_table,
)
from broadsheet.functions.labels import normalise_by_variable
from broadsheet.functions.text import compute_once, stacked
from broadsheet.functions.votes import all_agree

PAIR = ["variable", "rater_1", "rater_2"]
KAPPA, ALPHA = "cohens_kappa", "krippendorff_alpha"


def _pairs_of(
    ratings: DataFrame, variables: Iterable[str] = VARIABLES, study: Study = STUDY
) -> list[tuple[str, str, str]]:
    """(variable, rater, rater) for which both columns are there, in rater order."""
    return [
        (v, a, b)
        for v in variables
        for a, b in combinations(study.raters, 2)
        if {study.column(a, v), study.column(b, v)} <= set(ratings.columns)
    ]


def _raters_of(answers: DataFrame) -> list[str]:
    """Columns that hold answers: one per rater, in rater order."""
    return [c for c in answers.columns if c not in ("art_num", "variable", "n")]


def _by_variable(ratings: DataFrame, variables: Iterable[str], study: Study, *keep: str) -> DataFrame:
    """One row per article and variable, one column per rater."""

    def answer(rater: str, variable: str) -> str:
        column = study.column(rater, variable)
        return column if column in ratings.columns else "CAST(NULL AS STRING)"

    cells = [f"'{v}', " + ", ".join(answer(r, v) for r in study.raters) for v in variables]
    return ratings.select(*keep, stacked(cells, ["variable", *study.raters]))


def _pairs_within(answers: DataFrame, keep: str) -> DataFrame:
    """Every pair of raters within each row of answers, with both values."""
    cells = [f"'{a}', '{b}', {a}, {b}" for a, b in combinations(_raters_of(answers), 2)]
    names = ["rater_1", "rater_2", "value_1", "value_2"]
    return answers.select(keep, "variable", stacked(cells, names))


def rater_pairs(ratings: DataFrame, variables: Iterable[str] = VARIABLES, study: Study = STUDY) -> DataFrame:
    """``art_num``, the pair and both values, for all pairs of raters."""
    variables = list(variables)
    pairs = _pairs_within(_by_variable(ratings, variables, study, "art_num"), "art_num")
    if len(_pairs_of(ratings, variables, study)) < len(variables) * len(list(combinations(study.raters, 2))):
        pairs = pairs.join(F.broadcast(_all_pairs(ratings, variables, study)), PAIR, "left_semi")  # constants: 70 rows for five raters
    return pairs.select("art_num", *PAIR, "value_1", "value_2")


def rating_patterns(
    ratings: DataFrame, variables: Iterable[str] = VARIABLES, raw: bool = False, study: Study = STUDY
) -> DataFrame:
    """``variable``, one column per rater, and the number of articles ``n``.

    With ``raw``, the answers are normalised here, once per distinct pattern.
    """
    patterns = (
        _by_variable(ratings, variables, study)
        .groupBy("variable", *study.raters)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not raw:
        return patterns
    answers = F.transform(
        F.array(*study.raters), lambda a: normalise_by_variable(F.col("variable"), a)
    )
    normal = compute_once(patterns.select("variable", "n", *study.raters), answers=answers)
    return (
        normal.groupBy("variable", *(F.get("answers", F.lit(i)).alias(r) for i, r in enumerate(study.raters)))
        .agg(F.sum("n").alias("n"))
    )


def merge_patterns(*tables: DataFrame) -> DataFrame:
    """Patterns of several sets of articles, counted together; patterns without articles are left out."""
    raters = _raters_of(tables[0])
    every = reduce(DataFrame.unionByName, (t.select("variable", *raters, "n") for t in tables))
    return every.groupBy("variable", *raters).agg(F.sum("n").alias("n")).where("n <> 0")


def retracted(patterns: DataFrame) -> DataFrame:
    """Patterns that take their articles away again when merged."""
    return patterns.withColumn("n", -F.col("n"))


def _both_given() -> Column:
    return F.col("value_1").isNotNull() & F.col("value_2").isNotNull()


def confusion(patterns: DataFrame) -> DataFrame:
    """Counts per pair and pair of answers, both answers given."""
    return (
        _pairs_within(patterns, "n")
        .where(_both_given())
        .groupBy(*PAIR, "value_1", "value_2")
        .agg(F.sum("n").alias("n"))
    )


def _all_pairs(ratings: DataFrame, variables: Iterable[str] = VARIABLES, study: Study = STUDY) -> DataFrame:
    """The pairs to report, a constant table: 70 rows for five raters."""
    return constant_table(ratings.sparkSession, ", ".join(PAIR), _pairs_of(ratings, variables, study))


def pair_valid_n(ratings: DataFrame, raw: bool = False, study: Study = STUDY) -> DataFrame:
    """Articles per pair that both raters answered."""
    counts = (
        _pairs_within(rating_patterns(ratings, raw=raw, study=study), "n")
        .groupBy(*PAIR)
        .agg(F.sum(F.when(_both_given(), F.col("n")).otherwise(0)).alias("n"))
    )
    return _all_pairs(ratings, study=study).join(F.broadcast(counts), PAIR, "left").select(
        *PAIR, F.coalesce("n", F.lit(0)).alias("n")
    )


def coincidence_matrix(ratings: DataFrame, raw: bool = False, study: Study = STUDY) -> DataFrame:
    """Ordered value pair counts over all raters; symmetric."""
    counts = confusion(rating_patterns(ratings, raw=raw, study=study))
    value_1, value_2, n = F.col("value_1"), F.col("value_2"), F.col("n")
    both_orders = F.array(
        F.struct(value_1.alias("value_1"), value_2.alias("value_2"), n.alias("n")),
        F.struct(value_2.alias("value_1"), value_1.alias("value_2"), n.alias("n")),
    )
    return (
        counts.select("variable", F.inline(both_orders))
        .groupBy("variable", "value_1", "value_2")
        .agg(F.sum("n").alias("n"))
    )


def _pair_sums(counts: DataFrame) -> DataFrame:
    """Per pair: n, agreements, and the two chance sums over the marginals."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    same = F.when(F.col("value_1") == F.col("value_2"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("value_1").alias("value"), n.alias("m1"), zero.alias("m2"), same.alias("same")),
        F.struct(F.col("value_2").alias("value"), zero.alias("m1"), n.alias("m2"), zero.alias("same")),
    )
    marginals = (
        counts.select(*PAIR, F.inline(sides))
        .groupBy(*PAIR, "value")
        .agg(*(F.sum(c).cast("double").alias(c) for c in ("m1", "m2", "same")))
    )
    return marginals.groupBy(*PAIR).agg(
        F.sum("m1").alias("n"),
        F.sum("same").alias("same"),
        F.sum(F.col("m1") * F.col("m2")).alias("cross"),
        F.sum((F.col("m1") + F.col("m2")) * (F.col("m1") + F.col("m2"))).alias("pooled"),
    )


def _kappa() -> Column:
    n = F.col("n")
    observed = F.col("same") / n
    expected = F.col("cross") / (n * n)
    return F.when(n >= 2, F.try_divide(observed - expected, 1 - expected))


def _pair_alpha() -> Column:
    n = F.col("n")
    return 1 - F.try_divide(1 - F.col("same") / n, 1 - F.col("pooled") / (4 * n * n))


def cohen_kappa(ratings: DataFrame, raw: bool = False, study: Study = STUDY) -> DataFrame:
    """Unweighted kappa per pair for the binary variables; null below two articles
    or when only one answer occurs."""
    return cohen_kappa_of(rating_patterns(ratings, BINARY_VARIABLES, raw, study))


def cohen_kappa_of(patterns: DataFrame) -> DataFrame:
    """`cohen_kappa` from counted patterns."""
    sums = _pair_sums(confusion(patterns.where(F.col("variable").isin(*BINARY_VARIABLES))))
    return sums.select(*PAIR, _kappa().alias("value"), F.col("n").cast("bigint").alias("n"))


def nominal_alpha(ratings: DataFrame, raw: bool = False, study: Study = STUDY) -> DataFrame:
    """Alpha per variable over all its raters, without small-sample terms.

    For an article with m answers, of which c agree with a given one, that
    answer adds m - 1 to the pairs and to its value's marginal, and c - 1 to the
    pairs that agree. Articles with one answer add nothing.
    """
    return nominal_alpha_of(rating_patterns(ratings, raw=raw, study=study))


def nominal_alpha_of(patterns: DataFrame) -> DataFrame:
    """`nominal_alpha` from counted patterns."""
    votes, n = [F.col(r) for r in _raters_of(patterns)], F.col("n")
    given = sum((v.isNotNull().cast("int") for v in votes), F.lit(0))
    cells = [
        F.struct(
            vote.alias("value"),
            ((given - 1) * n).alias("pairs"),
            ((sum((_same(v, vote) for v in votes), F.lit(0)) - 1) * n).alias("same"),
        )
        for vote in votes
    ]
    per_value = (
        patterns.select("variable", F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(*(F.sum(c).cast("double").alias(c) for c in ("pairs", "same")))
    )
    sums = per_value.groupBy("variable").agg(
        F.sum("pairs").alias("pairs"),
        F.sum("same").alias("same"),
        F.sum(F.col("pairs") * F.col("pairs")).alias("squares"),
    )
    pairs = F.when(F.col("pairs") > 0, F.col("pairs"))
    disagreed = 1 - F.col("same") / pairs
    expected = 1 - F.col("squares") / (pairs * pairs)
    return sums.select("variable", (1 - F.try_divide(disagreed, expected)).alias("value"))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("int")


def irr_table(ratings: DataFrame, digits: int | None = 3, raw: bool = False, study: Study = STUDY) -> DataFrame:
    """Kappa (binary) or alpha (nominal) for every variable and pair of raters."""
    return irr_table_of(rating_patterns(ratings, raw=raw, study=study), _all_pairs(ratings, study=study), digits)


def irr_table_of(patterns: DataFrame, pairs: DataFrame | None = None, digits: int | None = 3) -> DataFrame:
    """`irr_table` from counted patterns, for the given pairs; for all by default."""
    if pairs is None:
        every = [(v, a, b) for v in VARIABLES for a, b in combinations(_raters_of(patterns), 2)]
        pairs = constant_table(patterns.sparkSession, ", ".join(PAIR), every)
    is_binary = F.col("variable").isin(*BINARY_VARIABLES)
    value = F.when(is_binary, _kappa()).otherwise(_pair_alpha())
    sums = _pair_sums(confusion(patterns)).select(*PAIR, value.alias("value"), "n")
    rounded = F.col("value") if digits is None else F.bround("value", digits)
    return pairs.join(F.broadcast(sums), PAIR, "left").select(  # constants: 70 rows for five raters
        *PAIR,
        F.when(is_binary, KAPPA).otherwise(ALPHA).alias("metric"),
        rounded.alias("value"),
        F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n"),
    )


def variable_labels(df: DataFrame) -> DataFrame:
    """Replace variable codes by their titles."""
    titles = F.create_map(*(F.lit(x) for pair in VARIABLES.items() for x in pair))
    return df.withColumn("variable", F.try_element_at(titles, F.col("variable")))


def irr_human_only(irr: DataFrame, study: Study = STUDY) -> DataFrame:
    return variable_labels(
        irr.where(F.col("rater_1").isin(*study.humans) & F.col("rater_2").isin(*study.humans))
    )


def irr_human_vs_model(irr: DataFrame, study: Study = STUDY) -> DataFrame:
    return variable_labels(
        irr.where(F.col("rater_1").isin(*study.humans) & F.col("rater_2").isin(*study.models))
    )


def label_disagreements(ratings: DataFrame, study: Study = STUDY) -> DataFrame:
    """Articles whose raters do not agree on the crime label."""
    columns = {
        r: study.column(r, "crime_label")
        for r in study.raters
        if study.column(r, "crime_label") in ratings.columns
    }
    labels = ratings.select("art_num", *(F.col(c).alias(r) for r, c in columns.items()))
    agreed = labels.withColumn("all_agree", all_agree(*map(F.col, columns)))
    return agreed.where(~F.col("all_agree"))
