"""Time the headline queries; prints one JSON line.

The input views are first written to Parquet, in several files as on a cluster;
that is not timed. Each query is then built, planned and run in full (its rows
go to a sink that drops them). The first run of each warms up the JVM and writes
the views it needs; the faster of the two after it counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.queries import BUILDERS, scratch
from workload.views import StoredViews

HEADLINE = (
    "curation_funnel", "curated_articles", "keyword_hits", "url_keyword_filter", "has_date",
    "html_text", "collect_matched_articles", "cap_per_source_year", "articles_with_ideology",
    "ideology_bin_counts", "ideology_mean_median", "state_counts", "region_counts",
    "people_with_ideology", "race_counts", "race_oe", "race_share", "first_non_null",
    "survey_pivot", "human_pair", "model_human_merge", "normalise_ratings", "rater_pairs",
    "cohen_kappa", "nominal_alpha", "irr_table", "label_disagreements", "src_article_blocks",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = StoredViews(spark, folder, scratch(spark, "bench"), 2 * int(cpus))
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            BUILDERS[name](tables).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
