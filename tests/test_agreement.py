import math
import random
from collections import Counter
from itertools import combinations

import pytest

from broadsheet.dims import MODELS, RATERS, VARIABLES, rating_column
from broadsheet.operators import agreement, ratings


def wide(spark, rows, columns):
    fields = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"art_num bigint, {fields}")


def alpha_by_pairs(units):
    """Alpha from the list of all ordered pairs of answers."""
    pairs = [(a, b) for u in units for i, a in enumerate(u) for j, b in enumerate(u)
             if i != j and a is not None and b is not None]
    if not pairs:
        return None
    do = sum(a != b for a, b in pairs) / len(pairs)
    de = 1 - sum((n / len(pairs)) ** 2 for n in Counter(a for a, _ in pairs).values())
    return 1 - do / de if de else None


def kappa_by_definition(units):
    both = [(a, b) for a, b in units if a is not None and b is not None]
    n = len(both)
    if n < 2:
        return None
    po = sum(a == b for a, b in both) / n
    first, second = Counter(a for a, _ in both), Counter(b for _, b in both)
    pe = sum(first[k] * second[k] for k in first) / n**2
    return (po - pe) / (1 - pe) if pe != 1 else None


def same(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9))


@pytest.mark.parametrize("seed,size", [(1, 40), (2, 3), (3, 1)])
def test_metrics_equal_their_definitions(spark, seed, size):
    rng = random.Random(seed)
    answers = {v: ["yes", "no", None] if v in ("crime_present", "violent_crime")
               else ["white", "black", "other", None] for v in VARIABLES}
    cells = [(r, v) for v in VARIABLES for r in RATERS]
    rows = [[rng.choice(answers[v]) for _, v in cells] for _ in range(size)]
    df = wide(spark, rows, [rating_column(r, v) for r, v in cells])
    at = {cell: i for i, cell in enumerate(cells)}
    irr = {(r.variable, r.rater_1, r.rater_2): r for r in agreement.irr_table(df, digits=None).collect()}
    valid = {(r.variable, r.rater_1, r.rater_2): r.n for r in agreement.pair_valid_n(df).collect()}
    assert len(irr) == len(valid) == 70
    for v in VARIABLES:
        for a, b in combinations(RATERS, 2):
            units = [(row[at[a, v]], row[at[b, v]]) for row in rows]
            row = irr[v, a, b]
            n = sum(None not in u for u in units)
            assert row.n == valid[v, a, b] == n
            binary = v in ("crime_present", "violent_crime")
            assert row.metric == ("cohens_kappa" if binary else "krippendorff_alpha")
            want = kappa_by_definition(units) if binary else alpha_by_pairs(units)
            assert same(row.value, want), (v, a, b)
    alphas = {r.variable: r.value for r in agreement.nominal_alpha(df).collect()}
    for v in VARIABLES:
        units = [[row[at[r, v]] for r in RATERS] for row in rows]
        assert same(alphas.get(v), alpha_by_pairs(units))


def test_edges(spark):
    columns = ["eleanor_crime_present", "sarah_crime_present", "eleanor_crime_label", "sarah_crime_label"]
    rows = [("yes", "yes", "a", "b"), ("yes", "yes", None, "a")]
    irr = {r.variable: r for r in agreement.irr_table(wide(spark, rows, columns)).collect()}
    assert set(irr) == {"crime_present", "crime_label"}
    assert irr["crime_present"].value is None and irr["crime_present"].n == 2  # one answer only
    assert irr["crime_label"].value == -1.0 and irr["crime_label"].n == 1  # alpha has no minimum
    rows = [("yes", "yes", "a", "a"), ("no", "no", "b", "b")]
    irr = {r.variable: r.value for r in agreement.irr_table(wide(spark, rows, columns)).collect()}
    assert irr == {"crime_present": 1.0, "crime_label": 1.0}
    irr = agreement.irr_table(wide(spark, [], columns)).collect()
    assert [(r.value, r.n) for r in irr] == [(None, 0)] * 2


def test_raw_patterns_equal_normalised_rows(spark):
    raw_values = {"yes": [" Yes", "no", "0", None], "race": ["White ", "asian", "unknown", "native"],
                  "gender": ["Male", "unknown", None, "multiple"], "label": ["Theft", "none", " arson", None]}
    rng = random.Random(5)
    cells = [(r, v) for v in VARIABLES for r in RATERS]

    def pick(v):
        kind = v.split("_")[1] if v.endswith(("race", "gender", "label")) else "yes"
        return rng.choice(raw_values[kind])

    df = wide(spark, [[pick(v) for _, v in cells] for _ in range(60)], [rating_column(r, v) for r, v in cells])
    fast = agreement.irr_table(df, raw=True).collect()
    slow = agreement.irr_table(ratings.normalise_ratings(df)).collect()
    assert sorted(map(str, fast)) == sorted(map(str, slow))
    assert agreement.irr_human_only(agreement.irr_table(df, raw=True)).count() == 7
    assert agreement.irr_human_vs_model(agreement.irr_table(df, raw=True)).count() == 42


def test_disagreements_and_coincidence(spark):
    columns = [rating_column(r, "crime_label") for r in RATERS]
    rows = [("a", "a", None, "a", "a"), ("a", None, "b", None, None), (None,) * 5]
    df = wide(spark, rows, columns)
    out = agreement.label_disagreements(df).collect()
    assert [(r.art_num, r.eleanor, r.gpt, r.all_agree) for r in out] == [(1, "a", "b", False)]
    counts = {(r.value_1, r.value_2): r.n for r in agreement.coincidence_matrix(df).collect()}
    assert counts == {("a", "a"): 12, ("a", "b"): 1, ("b", "a"): 1}


def test_pairs_of_the_columns_there_are(spark):
    df = wide(spark, [("a", None, "b")], ["eleanor_crime_label", "gpt_crime", "llama_perp_race"])
    got = [tuple(r) for r in agreement.rater_pairs(df).collect()]
    assert got == [(0, "crime_label", "eleanor", "gpt", "a", None)]


def test_long_form_and_model_majority(spark):
    columns = ["gpt_crime", "llama_crime", "qwen_crime", "eleanor_crime_label"]
    df = wide(spark, [("a", "b", "a", "c"), ("a", None, None, None)], columns)
    long = {(r.art_num, r.rater): r.value for r in ratings.ratings_wide_to_long(df).collect()}
    assert long[0, "llama"] == "b" and long[1, "eleanor"] is None and len(long) == 8
    voted = ratings.with_model_majority(df).orderBy("art_num").collect()
    assert [r.crime_label_llm_majority for r in voted] == ["a", None]
    assert set(MODELS) == {"gpt", "llama", "qwen"}


def test_batches_add_up_to_the_whole(spark, tmp_path):
    from broadsheet.plans.agreement import update_agreement

    rng = random.Random(6)
    cells = [(r, v) for v in VARIABLES for r in RATERS]
    columns = [rating_column(r, v) for r, v in cells]
    rows = [[rng.choice(["yes", "no", "white", None]) for _ in cells] for _ in range(90)]
    whole, store = wide(spark, rows, columns), str(tmp_path)
    first = wide(spark, [[rng.choice(["yes", "no", None]) for _ in cells] for _ in range(30)], columns)
    update_agreement(spark, first, store, 1)
    update_agreement(spark, wide(spark, rows[30:60], columns), store, 2)
    for _ in range(2):  # a batch may run again
        patterns = update_agreement(spark, wide(spark, rows[60:], columns), store, 3)
    patterns = update_agreement(spark, wide(spark, rows[:30], columns), store, 4, replaced=first)
    same_rows = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same_rows(agreement.irr_table_of(patterns), agreement.irr_table(whole))
    assert same_rows(agreement.cohen_kappa_of(patterns), agreement.cohen_kappa(whole))
    assert same_rows(agreement.nominal_alpha_of(patterns), agreement.nominal_alpha(whole))
    assert same_rows(patterns.select("variable", *RATERS, "n"), agreement.rating_patterns(whole).select("variable", *RATERS, "n"))
    assert "batch=3" not in str(patterns.inputFiles()) and len({f.split("batch=")[1][0] for f in patterns.inputFiles()}) == 1
