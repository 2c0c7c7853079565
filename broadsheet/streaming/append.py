"""Curate article blocks as they arrive, and go on where the last run stopped.

Curation looks at one article at a time, so the batch operator serves a stream
unchanged and no state is kept. The stream's checkpoint remembers which files
are done.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from broadsheet.dims import TIER1_TERMS, TIER2_TERMS
from broadsheet.operators.curation import curate
from broadsheet.sources.readers import parse_article_blocks


def article_block_stream(spark: SparkSession, path: str, newline: str = "\n") -> DataFrame:
    blocks = spark.readStream.option("lineSep", f"{newline}---{newline}").text(path)
    return parse_article_blocks(blocks)


def append_curated(
    articles: DataFrame,
    out: str,
    checkpoint: str,
    tier1: Iterable[str] = TIER1_TERMS,
    tier2: Iterable[str] = TIER2_TERMS,
) -> StreamingQuery:
    """Process what is there, append it to ``out`` and stop.

    ``out`` and ``checkpoint`` belong in storage that all executors share.
    """
    return (
        curate(articles, tier1=tier1, tier2=tier2)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
