"""Corpus cleaning in five stages; each is written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents;
the last returns the packed pieces. Documents go that have no letters (no language), that
are toxic, that repeat another document (five-word n-grams, similarity 0.8; of a class the
least doc_id stays, null ids last, and of a repeated row one) or that hold a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import langid, toxicity
from broadsheet.llm.common import ship_package, stored
from broadsheet.llm.decontaminate import drop_contaminated
from broadsheet.llm.jaccard import one_of_each
from broadsheet.llm.packing import pack
from broadsheet.llm.queries import TOXIC, id_fold, table, vocabulary_file

LEAST_SCORE = 0.5  #: of the best language


def _whole() -> list:
    """The row as one column, so that results cannot clash with its names."""
    return [F.struct("*").alias("row")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(id_fold(5) != 0), vocabulary_file("piece_bpe_32k.model"))
    rated = langid.predict(docs, model, _whole())
    return rated.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = id_fold(4) != 2
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.score(docs, model, _whole()).where(F.col("score") < TOXIC).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, width=5, num=4, den=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", benchmark), ("packing", packing)]

#: SQL can express none of the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
