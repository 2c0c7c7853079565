"""Constants and the small dimension tables built from them.

Every value below is a fixed value: results depend on it exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: keyword dictionaries -------------------------------------
# Some terms end in a blank on purpose; tier 2 lists some terms twice.

TIER1_TERMS = (
    "sexual-abuse", "sexual_abuse", "physical-abuse", "physical_abuse",
    "child-abuse", "child_abuse", "violen", "burgl", "kidnap", "assault",
    "murder", "homicid", "manslaughter", "hit-and-run", "hit_and_run",
    "-terrori", "_terrori", "crime", "shooting", "-robb", "_robb", "-rape",
    "_rape", "-raping", "_raping", "-molest", "_molest", "sex-crim",
    "sex_crim", "sexual-crim", "sexual_crim", "sex-offen", "sex_offen",
    "sexual-offen", "sexual_offen", "sexual-assault", "sexual_assault",
    "sexually-assault", "sexually_assault", "child-endangerment",
    "child_endangerment", "child-porn", "child_porn", "child-neglect",
    "child_neglect", "-stab-", "_stab_", "-stabbing", "_stabbing", "-stabbed",
    "_stabbed", "-mugging", "_mugging", "-mugged", "_mugged", "killing",
    "perpetrator", "offender", "assailant", "criminal", "felon", "convict ",
    "convicts ", "convicted", "attacker", "gangst", "mobst", "killer",
    "shooter", "rapist",
)

TIER2_TERMS = (
    "-offense", "_offense", "-riot", "_riot", "-misconduct", "_misconduct",
    "-trespass", "_trespass", "-violator", "_violator", "-hate-crim",
    "_hate-crim", "-hate_crim", "_hate_crim", "-attack", "_attack",
    "-battery", "_battery", "-traffick", "_traffick", "-arson", "_arson",
    "-illegal", "_illegal", "-shoot", "_shoot", "-shot", "_shot", "-looting",
    "_looting", "-looted", "_looted", "-detain", "_detain", "-apprehend",
    "_apprehend", "-bludgeon", "_bludgeon", "-strangul", "_strangul",
    "-strangl", "_strangl", "-lawbreak", "_lawbreak", "-gang-leader",
    "_gang-leader", "-gang_leader", "_gang_leader", "-defendant",
    "_defendant", "-suspect", "_suspect", "-suspect", "_suspect", "-suspects",
    "_suspects", "-suspects", "_suspects", "-fugiti", "_fugiti",
    "-accomplic", "_accomplic", "-predator", "_predator", "-predator",
    "_predator", "-predators", "_predators", "-predators", "_predators",
    "-looter", "_looter", "-innocent", "_innocent", "-innocence",
    "_innocence", "-witness", "_witness", "-suffocated", "_suffocated",
    "-victim", "_victim", "-accuser", "_accuser", "-minor", "_minor",
)

# --- fixed values: crawl ----------------------------------------------------

CRAWL_COLLECTIONS = {
    2018: ("CC-MAIN-2018-43",),
    2019: ("CC-MAIN-2019-09",),
    2020: ("CC-MAIN-2020-10",),
    2023: ("CC-MAIN-2023-06",),
    2024: (
        "CC-MAIN-2024-10", "CC-MAIN-2024-18", "CC-MAIN-2024-22",
        "CC-MAIN-2024-26", "CC-MAIN-2024-30", "CC-MAIN-2024-33",
        "CC-MAIN-2024-38", "CC-MAIN-2024-42", "CC-MAIN-2024-46",
        "CC-MAIN-2024-51",
    ),
}
HOST_PREFIXES = ("news", "blog", "m", "mobile", "editorial")
FIRST_YEAR, LAST_YEAR = 2018, 2024
MAX_PER_SOURCE_YEAR = 80
MIN_CHARS = 1000
BODY_DIV_CLASSES = (
    "content__article-body", "article-body", "l-container", "zn-body-text",
    "pg-rail-tall__body",
)

# --- fixed values: ideology -------------------------------------------------

IDEOLOGY_LEFT = "Left-leaning (< -0.1)"
IDEOLOGY_CENTER = "Center (-0.1 to 0.1)"
IDEOLOGY_RIGHT = "Right-leaning (> 0.1)"
IDEOLOGY_BINS = (IDEOLOGY_LEFT, IDEOLOGY_CENTER, IDEOLOGY_RIGHT)
IDEOLOGY_SIGNS = ("negative", "positive")
HIST_BINS = 19

# --- fixed values: states ---------------------------------------------------

REGION_STATES = {
    "Northeast": "CT ME MA NH RI VT NJ NY PA".split(),
    "Midwest": "IL IN MI OH WI IA KS MN MO NE ND SD".split(),
    "South": "DE FL GA MD NC SC VA WV AL KY MS TN AR LA OK TX".split(),
    "West": "AZ CO ID MT NV NM UT WY AK CA HI OR WA".split(),
}
VALID_STATES = tuple(sorted(s for group in REGION_STATES.values() for s in group))

# state: (white share, black share)
STATE_POPULATION = {
    "AL": (0.6536, 0.2609), "AK": (0.6070, 0.0310), "AZ": (0.6320, 0.0464),
    "AR": (0.7086, 0.1491), "CA": (0.4395, 0.0554), "CO": (0.7346, 0.0401),
    "CT": (0.6757, 0.1069), "DE": (0.6182, 0.2194), "DC": (0.3907, 0.4326),
    "FL": (0.5991, 0.1534), "GA": (0.6050, 0.3240), "HI": (0.2220, 0.0220),
    "ID": (0.7900, 0.0090), "IL": (0.6100, 0.1460), "IN": (0.8510, 0.0980),
    "IA": (0.9070, 0.0400), "KS": (0.7560, 0.0580), "KY": (0.8760, 0.0840),
    "LA": (0.6290, 0.3270), "ME": (0.9460, 0.0160), "MD": (0.5880, 0.3090),
    "MA": (0.8080, 0.0890), "MI": (0.7930, 0.1410), "MN": (0.8410, 0.0680),
    "MS": (0.5910, 0.3780), "MO": (0.8300, 0.1100), "MT": (0.8310, 0.0200),
    "NE": (0.8800, 0.0500), "NV": (0.6200, 0.0700), "NH": (0.8980, 0.0200),
    "NJ": (0.8080, 0.1600), "NM": (0.5100, 0.0210), "NY": (0.6150, 0.1800),
    "NC": (0.7350, 0.2200), "ND": (0.8700, 0.0200), "OH": (0.7930, 0.1400),
    "OK": (0.6900, 0.0700), "OR": (0.8200, 0.0200), "PA": (0.7200, 0.1200),
    "RI": (0.8000, 0.1000), "SC": (0.5900, 0.2600), "SD": (0.8070, 0.0200),
    "TN": (0.7900, 0.1490), "TX": (0.5000, 0.1400), "UT": (0.8300, 0.0200),
    "VT": (0.9010, 0.0100), "VA": (0.7400, 0.2000), "WA": (0.7800, 0.0400),
    "WV": (0.9000, 0.0200), "WI": (0.7900, 0.0700), "WY": (0.8300, 0.0160),
}

# --- fixed values: annotation study -----------------------------------------

HUMANS = ("eleanor", "sarah")
MODELS = ("gpt", "llama", "qwen")
RATERS = HUMANS + MODELS
VARIABLES = {
    "crime_present": "Crime Present",
    "violent_crime": "Violent Crime",
    "crime_label": "Crime Label",
    "perp_race": "Perpetrator Race",
    "perp_gender": "Perpetrator Gender",
    "victim_race": "Victim Race",
    "victim_gender": "Victim Gender",
}
BINARY_VARIABLES = ("crime_present", "violent_crime")
NOMINAL_VARIABLES = tuple(v for v in VARIABLES if v not in BINARY_VARIABLES)

# variable: text that identifies its survey question
SURVEY_QUESTIONS = {
    "crime_present": "Q1_CRIME_COMMITTED",
    "violent_crime": "Q2_VIOLENT",
    "perp_race": "Q4_PERP_RACE",
    "perp_gender": "Q6_PERP_GENDER",
    "victim_race": "Q9_VICTIM_RACE",
    "victim_gender": "Q11_VICTIM_GENDER",
    "crime_label": "Q13_CRIME_LABEL",
}
SURVEY_FIRST_ANSWER = "ART0001_Q1_CRIME_COMMITTED"

RACES = ("white", "black", "other")
ROLES = ("perp", "victim")

# Cell texts that mean "missing" in the annotation CSV files.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Study:
    """Who rated the articles: people, named by their place in the survey, and models.

    Names are lower-case letters and digits, since they begin column names.
    """

    humans: tuple[str, ...] = HUMANS
    models: tuple[str, ...] = MODELS

    def __post_init__(self) -> None:
        reserved = {"variable", "n", "value", "art"}
        bad = [r for r in self.raters if not re.fullmatch("[a-z][a-z0-9]*", r) or r in reserved]
        if bad or len(set(self.raters)) < len(self.raters):
            raise ValueError(f"raters need distinct names of lower-case letters and digits: {bad or self.raters}")

    @property
    def raters(self) -> tuple[str, ...]:
        return (*self.humans, *self.models)

    def column(self, rater: str, variable: str) -> str:
        """Column of the ratings table; models name the crime label just ``crime``."""
        if rater in self.models and variable == "crime_label":
            return f"{rater}_crime"
        return f"{rater}_{variable}"


STUDY = Study()


def rating_column(rater: str, variable: str) -> str:
    """`Study.column` of the study at hand."""
    return STUDY.column(rater, variable)


def parse_years(years: str) -> list[int]:
    """``"2019"`` or ``"2018-2020"`` as a list of years; anything else is an error."""
    form = re.fullmatch(r"(\d{4})(?:-(\d{4}))?", years)
    if not form:
        raise ValueError(f"not a year or a year range: {years!r}")
    first = int(form[1])
    last = int(form[2] or first)
    if not FIRST_YEAR <= first <= last <= LAST_YEAR:
        raise ValueError(f"years must ascend within {FIRST_YEAR}-{LAST_YEAR}: {years!r}")
    return list(range(first, last + 1))


def collections_of(years: str) -> list[str]:
    """The collections of a year or year range, 14 at most; some years have none."""
    return [name for year in parse_years(years) for name in CRAWL_COLLECTIONS.get(year, ())]


def sql_literal(value: str | int | float) -> str:
    """A constant as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def constant_table(spark: SparkSession, columns: str, rows: Iterable[tuple]) -> DataFrame:
    """A table of constants; the optimizer sees its rows and therefore its size."""
    listed = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({columns})")


def state_regions(spark: SparkSession) -> DataFrame:
    """50 rows ``(state, region)``."""
    rows = [(s, region) for region, states in REGION_STATES.items() for s in states]
    return constant_table(spark, "state, region", rows)


def state_population(spark: SparkSession) -> DataFrame:
    """51 rows ``(state, white_prop, black_prop, other_prop)``, DC included."""
    rows = [(state, *shares) for state, shares in STATE_POPULATION.items()]
    shares = constant_table(spark, "state, white_prop, black_prop", rows)
    return shares.withColumn("other_prop", 1 - (F.col("white_prop") + F.col("black_prop")))


def crawl_collections(spark: SparkSession) -> DataFrame:
    """14 rows ``(year, collection, coll_pos)``; some years have no collection."""
    rows = [
        (year, name, pos)
        for year, names in CRAWL_COLLECTIONS.items()
        for pos, name in enumerate(names)
    ]
    return constant_table(spark, "year, collection, coll_pos", rows)


def ideology_bins(spark: SparkSession) -> DataFrame:
    """3 rows ``(bin_pos, category)``."""
    return constant_table(spark, "bin_pos, category", list(enumerate(IDEOLOGY_BINS)))


def race_grid(spark: SparkSession) -> DataFrame:
    """12 rows ``(ideology, role, race)``: every cell of the representation table."""
    return constant_table(spark, "ideology, role, race", product(IDEOLOGY_SIGNS, ROLES, RACES))


def keyword_terms(spark: SparkSession) -> DataFrame:
    """Both dictionaries as ``(tier, term)``, duplicates kept."""
    rows = [(1, t) for t in TIER1_TERMS] + [(2, t) for t in TIER2_TERMS]
    return constant_table(spark, "tier, term", rows)
