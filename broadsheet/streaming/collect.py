"""Collection of articles from index files that arrive over time.

Every micro-batch of index records is matched, its pages are parsed once, and its articles
are capped by what is kept of their source and year already. That number, and the last
year per domain, is the state: after each batch a table of it is written as a whole, keyed
by the number of the batch. A batch reads the state of the one before and overwrites its
own folders, so a batch that died half-way and runs again (Spark repeats it with the same
files) leaves the same rows as one that never died. State holds one narrow row per source
and year; articles are never read again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.dims import MAX_PER_SOURCE_YEAR
from broadsheet.functions.urls import url_netloc
from broadsheet.operators.crawl import ALL_TERMS, cap_after, crawl_targets, of_years
from broadsheet.plans.collect import articles_of, stored_candidates

TAKEN = "source_id bigint, year int, n bigint"
LAST_YEARS = "domain string, last_year int"


def state(spark: SparkSession, out: str, name: str, schema: str, batch: int | None = None) -> DataFrame:
    """The table ``name`` of the state after a batch, the last one by default; empty before the first."""
    folder = f"{out}/state/{name}"
    if batch is None:
        try:
            done = spark.read.schema("batch int").parquet(f"{out}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            done = spark.createDataFrame([], "batch int")
        batch = done.agg(F.max("batch")).first()[0]
    if batch is None or batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch}")


def taken_per_source_year(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    return state(spark, out, "taken", TAKEN, batch)


def collected_last_years(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """Last collected year per domain, for `resume_filter`, without reading articles."""
    return state(spark, out, "last_years", LAST_YEARS, batch)


def collected(spark: SparkSession, out: str) -> DataFrame:
    """Articles of the batches whose state is written."""
    done = spark.read.schema("batch int").parquet(f"{out}/log").distinct()
    return spark.read.parquet(f"{out}/articles").join(F.broadcast(done), "batch", "left_semi").drop("batch")  # narrow, a row per batch


def collect_batch(
    records: DataFrame, batch: int, sources: DataFrame, pages: DataFrame, years: str, out: str,
    terms: Iterable[str] = ALL_TERMS, k: int = MAX_PER_SOURCE_YEAR,
) -> None:
    """Collect one batch of index records into ``out``; may run again with the same records."""
    spark = records.sparkSession
    if "index_pos" not in records.columns:  # rows of a stream are numbered within their batch
        records = records.withColumn("index_pos", F.struct("file", "block", F.monotonically_increasing_id().alias("seq"))).drop("file", "block")
    before = taken_per_source_year(spark, out, batch - 1)
    candidates = stored_candidates(crawl_targets(sources, years), of_years(records, years), terms)
    found = articles_of(candidates, pages, terms, lambda articles: cap_after(articles, before, k))
    path = f"{out}/articles/batch={batch}"
    found.select("source_id", "source", "state", "url", "year", "matched_keywords", "text").write.mode("overwrite").parquet(path)
    new = spark.read.parquet(path).select("source_id", "year", "url")

    def keep(name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{out}/state/{name}/batch={batch}")

    counts = new.groupBy("source_id", "year").agg(F.count("*").alias("n"))
    keep("taken", before.unionByName(counts).groupBy("source_id", "year").agg(F.sum("n").alias("n")))
    last = new.groupBy(url_netloc(F.col("url")).alias("domain")).agg(F.max("year").alias("last_year"))
    earlier = collected_last_years(spark, out, batch - 1)
    keep("last_years", earlier.unionByName(last).groupBy("domain").agg(F.max("last_year").alias("last_year")))
    # Last, so that a batch counts once all of it is there; one more line of a repeated batch does no harm.
    spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("append").parquet(f"{out}/log")


def collect_stream(
    index: DataFrame, sources: DataFrame, pages: DataFrame, years: str, out: str, checkpoint: str,
    terms: Iterable[str] = ALL_TERMS, k: int = MAX_PER_SOURCE_YEAR,
) -> StreamingQuery:
    """Collect what has arrived and stop; the next call goes on where this one stopped."""
    terms = tuple(terms)
    return (
        index.writeStream.foreachBatch(lambda records, batch: collect_batch(records, batch, sources, pages, years, out, terms, k))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
