"""The data series behind the figures.

Articles and people are counted per domain before they meet the source list, so
a domain with a third of all rows is one pre-aggregated row in every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.dims import (
    HIST_BINS, IDEOLOGY_SIGNS, RACES, ROLES, STUDY, VALID_STATES, Study, ideology_bins, race_grid,
    state_population, state_regions,
)
from broadsheet.functions.labels import (
    is_charted_race, norm_race_counts, race_class_oe, race_series_label,
)
from broadsheet.functions.scores import hist_bin, ideology_bin, ideology_sign, oe_ratio_ci
from broadsheet.functions.text import compute_once, stacked
from broadsheet.functions.urls import source_url_norm, url_domain, url_netloc_nowww
from broadsheet.functions.votes import majority_unique, race_vote_raw

# --- articles and ideology ----------------------------------------------------


def _scored_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("ideology").isNotNull()).select(
        url_domain(F.col("URL")).alias("_domain"), "ideology"
    )


def articles_with_ideology(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of scored sources; several sources of one domain repeat the article.

    Left join plus "score is there" is an inner join. Missing URLs match each
    other. No join hint: see `crawl_candidates`.
    """
    scored = _scored_sources(sources)
    keyed = articles.withColumn("domain", url_domain(F.col("url")))
    return keyed.join(scored, keyed["domain"].eqNullSafe(scored["_domain"])).drop("_domain")


def ideology_scores(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``(domain, ideology, n)``: `articles_with_ideology`, counted."""
    counts = articles.groupBy(url_domain(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n")
    )
    scored = _scored_sources(sources)
    return counts.join(scored, counts["domain"].eqNullSafe(scored["_domain"])).drop("_domain")


def ideology_bin_counts(scores: DataFrame) -> DataFrame:
    """Articles per bin, in bin order, empty bins included."""
    counted = scores.groupBy(ideology_bin(F.col("ideology")).alias("category")).agg(
        F.sum("n").alias("n")
    )
    bins = ideology_bins(scores.sparkSession)
    return (
        bins.join(F.broadcast(counted), "category", "left")  # at most 4 rows
        .select("bin_pos", "category", F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("bin_pos")
    )


def ideology_hist(scores: DataFrame) -> DataFrame:
    """Articles per histogram bin 1-19, empty bins included."""
    counted = scores.groupBy(hist_bin(F.col("ideology")).alias("bin")).agg(F.sum("n").alias("n"))
    bins = scores.sparkSession.range(1, HIST_BINS + 1, 1, 1).select(
        F.col("id").cast("int").alias("bin")
    )
    return (
        bins.join(F.broadcast(counted), "bin", "left")  # at most 20 rows
        .select("bin", F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("bin")
    )


def ideology_mean_median(scores: DataFrame) -> DataFrame:
    """Mean and exact median over articles; the count serves as a weight."""
    return scores.agg(
        F.try_divide(F.sum(F.col("ideology") * F.col("n")), F.sum("n")).alias("mean"),
        F.percentile("ideology", F.lit(0.5), F.col("n")).alias("median"),
    )


# --- states and regions -------------------------------------------------------


def valid_state(df: DataFrame) -> DataFrame:
    """Rows with one of the 50 state codes as written; DC is not among them."""
    return df.where(F.col("state").isin(*VALID_STATES))


def state_counts(articles: DataFrame) -> DataFrame:
    """Articles per valid state, most first."""
    return (
        valid_state(articles)
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "state")
    )


def region_lookup(df: DataFrame) -> DataFrame:
    """Add ``region``; null for DC and unknown codes."""
    return df.join(F.broadcast(state_regions(df.sparkSession)), "state", "left")  # 50 rows


def region_counts(articles: DataFrame) -> DataFrame:
    """Articles and distinct states per region."""
    per_state = articles.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return (
        region_lookup(per_state)
        .where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.sum("n").alias("count"), F.count("state").alias("n_states"))
        .orderBy(F.desc("count"), "region")
    )


# --- people and race ----------------------------------------------------------


def _signed_sources(sources: DataFrame) -> DataFrame:
    return sources.select(
        source_url_norm(F.col("URL")).alias("url_norm"),
        "ideology",
        "state",
        ideology_sign(F.col("ideology")).alias("ideology_label"),
    ).where(F.col("ideology_label").isNotNull())


def people_with_ideology(people: DataFrame, sources: DataFrame) -> DataFrame:
    """People of sources that lean either way; the state is the source's."""
    keyed = people.drop("ideology", "state").withColumn(
        "url_norm", url_netloc_nowww(F.col("url"))
    )
    return keyed.join(_signed_sources(sources), "url_norm")


def people_with_population(people: DataFrame) -> DataFrame:
    """Add the race shares of the state; people without a known state drop out."""
    return people.join(F.broadcast(state_population(people.sparkSession)), "state")  # 51 rows


def race_votes_by_source(people: DataFrame, sources: DataFrame, prepare, decide, study: Study = STUDY) -> DataFrame:
    """People counted per leaning source, role and voted race, joined to the source.

    Raw answers repeat a great deal, so people with the same answers are counted
    first; ``prepare`` (for each model's answer) and ``decide`` (the vote) then
    run once per distinct set of answers. A race may appear in several rows.
    """

    def answer(model: str, role: str) -> str:
        column = f"{model}_{role}_race"
        return column if column in people.columns else "CAST(NULL AS STRING)"

    models = study.models
    cells = [f"'{role}', " + ", ".join(answer(m, role) for m in models) for role in ROLES]
    hosts = compute_once(people, _host=url_netloc_nowww(F.col("url")))  # not once per role
    answers = hosts.select(
        F.col("_host").alias("url_norm"), stacked(cells, ["role", *models])
    )
    counts = answers.groupBy("url_norm", "role", *models).agg(F.count(F.lit(1)).alias("n"))
    prepared = compute_once(counts, **{f"_{m}": prepare(F.col(m)) for m in models})
    votes = prepared.select(
        "url_norm", "role", "n", decide(*(F.col(f"_{m}") for m in models)).alias("race")
    )
    voted = votes.where(F.col("race").isNotNull())
    return voted.join(_signed_sources(sources), "url_norm")


def race_counts(people: DataFrame, sources: DataFrame, study: Study = STUDY) -> DataFrame:
    """People per role, race and ideology; each answer is normalised, then voted on."""
    return (
        race_votes_by_source(people, sources, norm_race_counts, majority_unique, study)
        .groupBy("role", "race", F.col("ideology_label").alias("ideology"))
        .agg(F.sum("n").alias("count"))
    )


def clean_race_series(counts: DataFrame) -> DataFrame:
    """Race labels as charted, without the ones that say nothing."""
    labelled = counts.withColumn("race", race_series_label(F.col("race")))
    return labelled.where(is_charted_race(F.col("race")))


def race_rollup_all(counts: DataFrame) -> DataFrame:
    """Cleaned counts plus a panel ``all`` that sums over ideologies."""
    clean = clean_race_series(counts).select("role", "race", "ideology", "count")
    total = (
        clean.groupBy("role", "race")
        .agg(F.sum("count").alias("count"))
        .withColumn("ideology", F.lit("all"))
    )
    return clean.unionByName(total)


def race_share(rollup: DataFrame) -> DataFrame:
    """Share of each bar in its panel. A panel holds a row per role and race."""
    panel = Window.partitionBy("ideology")
    return rollup.where(F.col("ideology").isin(*IDEOLOGY_SIGNS, "all")).withColumn(
        "proportion", F.try_divide(F.col("count"), F.sum("count").over(panel))
    )


def race_oe(people: DataFrame, sources: DataFrame, study: Study = STUDY) -> DataFrame:
    """Observed and expected counts for all 12 cells of ideology, role and race.

    Answers are voted on first and normalised after. Expected is the sum of the
    states' shares over everyone with a race in that ideology and role.
    """
    voted = people_with_population(
        race_votes_by_source(
            people, sources, race_vote_raw, lambda *votes: race_class_oe(majority_unique(*votes)), study
        )
    )
    n = F.col("n")
    sums = []
    for race in RACES:
        sums.append(F.sum(F.when(F.col("race") == race, n).otherwise(0)).alias(f"o_{race}"))
        sums.append(F.sum(n * F.col(f"{race}_prop")).alias(f"e_{race}"))
    totals = voted.groupBy("ideology_label", "role").agg(*sums)
    cells = F.array(
        *(
            F.struct(
                F.lit(race).alias("race"),
                F.col(f"o_{race}").alias("observed"),
                F.col(f"e_{race}").alias("expected"),
            )
            for race in RACES
        )
    )
    by_race = totals.select(F.col("ideology_label").alias("ideology"), "role", F.inline(cells))
    grid = race_grid(people.sparkSession)
    keys = ["ideology", "role", "race"]
    return grid.join(F.broadcast(by_race), keys, "left").select(  # at most 12 rows
        *keys,
        F.coalesce("observed", F.lit(0)).alias("observed"),
        F.coalesce("expected", F.lit(0.0)).alias("expected"),
    )


def with_oe_ratio_ci(cells: DataFrame) -> DataFrame:
    """Add ratio, 95 % interval and error-bar lengths to `race_oe`."""
    return cells.withColumns(oe_ratio_ci(F.col("observed"), F.col("expected")))
