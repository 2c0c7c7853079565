import math
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from broadsheet.dims import IDEOLOGY_CENTER, IDEOLOGY_LEFT, IDEOLOGY_RIGHT, VALID_STATES, parse_years
from broadsheet.functions import labels, scores, votes


def test_labels(apply):
    values = [None, "", " NaN", "None", " Murder ", " Theft"]
    assert apply(labels.norm_label, values) == [None, None, None, None, "murder", "theft"]
    values = ["Yes", " TRUE", "1", "no", "False", "0", "maybe", None, "1.0"]
    assert apply(labels.norm_yes_no, values) == ["yes"] * 3 + ["no"] * 3 + [None] * 3


RACES = ["White", "black ", "Hispanic", "native", "unknown", "multiple", "not provided",
         "not_provided", "no name provided", "", "none", "martian", None]


def test_race_normalisers_differ(apply):
    assert apply(labels.norm_race_irr, RACES) == [
        "white", "black", "other", "other", None, None, None, None, None, None, None, "martian", None]
    assert apply(labels.norm_race_oe, RACES) == [
        "white", "black", "other", "other", None, "other", "other", None, "other", None, "other", "other", None]
    assert apply(labels.norm_race_counts, RACES) == [
        "white", "black", "other", "other", None, None, None, None, "other", None, "other", "other", None]


def test_gender_keeps_unknown(apply):
    values = ["Male", "unknown", "Nonbinary/Other", "multiple", None, "none"]
    assert apply(labels.norm_gender_irr, values) == ["male", "unknown", None, None, None, None]


@pytest.mark.parametrize("normalise", [
    labels.norm_label, labels.norm_yes_no, labels.norm_race_irr, labels.norm_gender_irr,
    labels.norm_race_oe, labels.norm_race_counts])
def test_idempotent(apply, normalise):
    once = apply(normalise, RACES + ["yes", "no", "male"])
    assert apply(normalise, once) == once


def test_model_column_normalisers():
    pick = labels.model_column_normaliser
    assert pick("gpt_violent_crime") is pick("qwen_crime_present") is labels.norm_yes_no
    assert pick("llama_victim_race") is labels.norm_race_irr
    assert pick("gpt_perp_gender") is labels.norm_gender_irr
    assert pick("gpt_crime") is labels.norm_label
    assert pick("gpt_age") is None and pick("url") is None


def test_charted_races(apply):
    label = lambda c: F.when(labels.is_charted_race(labels.race_series_label(c)), labels.race_series_label(c))
    assert apply(label, [" White", None, "not provided", "none", ""]) == ["white", "nan", None, None, None]


def _vote(spark, vote, triples):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "i int, a string, b string, c string")
    rows = df.select("i", vote(F.col("a"), F.col("b"), F.col("c")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_votes_equal_counting(spark):
    triples = list(product(["x", "y", "z", None], repeat=3))

    def count(triple, unique):
        given = [v for v in triple if v is not None]
        most = max(map(given.count, given), default=0)
        leaders = {v for v in given if given.count(v) == most}
        return leaders.pop() if len(leaders) == 1 and (unique or most > 1) else None

    assert _vote(spark, votes.majority_strict, triples) == [count(t, False) for t in triples]
    assert _vote(spark, votes.majority_unique, triples) == [count(t, True) for t in triples]
    assert _vote(spark, votes.all_agree, triples) == [len(set(t) - {None}) <= 1 for t in triples]


def test_two_race_votes_differ(spark):
    triples = [("asian", "hispanic", "white"), ("multiple", "multiple", "white"),
               ("unknown", "unknown", "black"), ("White", None, ""), ("not provided", None, None)]
    assert _vote(spark, votes.vote_then_norm, triples) == [None, "other", None, "white", "other"]
    assert _vote(spark, votes.norm_then_vote, triples) == ["other", "white", "black", "white", None]


def test_vote_needs_two_or_three():
    with pytest.raises(ValueError):
        votes.majority_strict(*(F.lit(i) for i in "abcd"))


def test_ideology(apply):
    values = [-1.0, -0.99, -0.1, 0.0, 0.1, 0.11, 1.0, 1.2, None]
    assert apply(scores.ideology_bin, values, "double") == [
        None, IDEOLOGY_LEFT, IDEOLOGY_LEFT, IDEOLOGY_CENTER, IDEOLOGY_CENTER, IDEOLOGY_RIGHT,
        IDEOLOGY_RIGHT, None, None]
    assert apply(scores.ideology_sign, [-0.2, 0.0, 0.3, None], "double") == ["negative", None, "positive", None]


def test_histogram_equals_numpy(apply):
    import numpy as np

    edges = np.linspace(-1, 1, 20)
    values = [float(e) for e in edges] + [-1.01, 1.01, 0.0, 0.999]
    got = apply(scores.hist_bin, values, "double")
    counts = Counter(b for b in got if b is not None)
    assert [counts.get(i, 0) for i in range(1, 20)] == list(np.histogram(values, bins=edges)[0])
    assert got[19] == 19 and got[20] is None and got[21] is None
    assert scores.hist_edges() == list(edges)


def test_ratio(spark):
    rows = [(1, 4, 2.0), (2, 0, 2.0), (3, 5, 0.0), (4, 0, 0.0)]
    df = spark.createDataFrame(rows, "i int, o bigint, e double")
    out = {r.i: r for r in df.select("i", *(
        c.alias(n) for n, c in scores.oe_ratio_ci(F.col("o"), F.col("e")).items())).collect()}
    assert out[1].ratio == 2.0
    assert math.isclose(out[1].ci_lower, math.exp(math.log(2) - 0.98))
    assert math.isclose(out[1].err_high, math.exp(math.log(2) + 0.98) - 2)
    assert out[2].ratio == 0 and out[2].ci_lower is None and out[2].err_low is None
    assert out[3].ratio is None and out[4].ratio is None


def test_years_and_states():
    assert parse_years("2018") == [2018] and parse_years("2019-2021") == [2019, 2020, 2021]
    for bad in ("2017", "2020-2019", "20", "2018-2025", "2018 - 2019", "٢٠١٨x"):
        with pytest.raises(ValueError):
            parse_years(bad)
    assert len(VALID_STATES) == 50 and "DC" not in VALID_STATES
