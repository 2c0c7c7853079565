import random
import re

from pyspark.sql import functions as F

from broadsheet.dims import TIER1_TERMS, TIER2_TERMS
from broadsheet.functions.text import (
    compute_once, has_date, has_keyword, hits_in_lowered, keyword_hits, min_chars, strip,
    with_lowered,
)

ALL_TERMS = TIER1_TERMS + TIER2_TERMS
PYTHON_DATES = [
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\w+ \d{1,2},? \d{4}\b", r"\b\d{1,2} \w+ \d{4}\b",
]


def test_dictionaries():
    assert (len(TIER1_TERMS), len(TIER2_TERMS), len(set(TIER2_TERMS))) == (70, 86, 78)
    assert "convict " in TIER1_TERMS and "convict" not in TIER1_TERMS


def test_strip_equals_python(apply):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [s + "a" + s + "b" + s for s in spaces] + ["", "  ", "​a​", "a"]
    assert apply(strip, values) == [v.strip() for v in values]


def test_hits_overlap_ignore_case_and_are_distinct(apply):
    texts = [
        "A Sexual-Assault, and an ASSAULT", "convict", "a convict on trial; convicts flee",
        "the -suspects", "_suspects", "nothing", "", None, "hate -hate_crim hit_and_run",
    ]
    expected = [
        sorted({t for t in ALL_TERMS if t in (text or "").lower()}) for text in texts
    ]
    assert expected[0] == ["assault", "sexual-assault"]
    assert expected[2] == ["convict ", "convicts "]
    assert apply(lambda c: keyword_hits(c, ALL_TERMS), texts) == expected


def test_fast_and_plain_hits_agree_with_a_search_for_every_term(spark):
    rng = random.Random(7)
    parts = list(set(ALL_TERMS)) + ["_", "-", "x", "é", " ", "\n", "sex", "child"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))).upper() for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    fast = compute_once(with_lowered(df, "t"), h=hits_in_lowered("_lowered", ALL_TERMS))
    out = fast.select(
        "i", "h", keyword_hits(F.col("t"), ALL_TERMS).alias("p"),
        has_keyword(F.col("t"), ALL_TERMS).alias("any"),
    )
    for row in out.collect():
        want = sorted({t for t in ALL_TERMS if t in texts[row.i].lower()})
        assert row.h == want and row.p == want and row.any == bool(want)


def test_dates_equal_python(apply):
    rng = random.Random(3)
    pieces = ["2021", "12", "3", "-", "/", " ", ",", "March", "août", "²", "٣", "_", "x", "\n", "é", "20211"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(3, 9))) for _ in range(4000)]
    texts += ["section 12 2024", "x12345-1-1", "Posted March 3, 2020.", "", "3 août 2019"]
    want = [any(re.search(p, t) for p in PYTHON_DATES) for t in texts]
    assert any(want) and not all(want)
    assert apply(has_date, texts) == want
    assert apply(has_date, [None]) == [False]


def test_min_chars_is_strict_and_strips(apply):
    texts = ["a" * 1000, "a" * 1001, " " * 50 + "a" * 1000 + " " * 50, "é" * 1001]
    assert apply(min_chars, texts) == [False, True, False, True]


def test_costly_column_is_not_copied_into_filters(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    low = with_lowered(df, "t").where(F.col("_lowered") != "1")
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
