"""Queries op1 to op10 and the pipeline over the tables, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import langid, toxicity
from broadsheet.llm.alignment import corpus_alignment
from broadsheet.llm.common import ship_package
from broadsheet.llm.decontaminate import contamination
from broadsheet.llm.jaccard import jaccard_classes
from broadsheet.llm.licenses import scan
from broadsheet.llm.lm import stupid_backoff
from broadsheet.llm.packing import pack
from broadsheet.llm.periodic import longest_exponent, periodic_runs
from broadsheet.llm.reputation import judge_urls, markup_outcome
from broadsheet.llm.spotjoin import place_classes
from broadsheet.llm.spotsigs import neighbour_fingerprints
from broadsheet.llm.token_counts import token_counts
from broadsheet.llm.tool_calls import link_tool_calls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Path of a public vocabulary; the driver and all executors have the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(id_fold(5) != 0), vocabulary_file("piece_bpe_32k.model"))
    return langid.predict(docs, model, ["doc_id", (id_fold(5) == 0).alias("held_out")])


#: From this score on a document is toxic; fixed by the contract.
TOXIC = 0.3


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = id_fold(4) != 2
    model = toxicity.fit(docs.where(learn), table(spark, folder, "labels").where(learn))
    scored = toxicity.score(docs, model, ["doc_id", (id_fold(4) == 2).alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


#: Tool -> argument -> (type, whether required).
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"query": ("string", True), "limit": ("integer", True)},
    "calculate": {"query": ("string", True), "limit": ("number", False)},
}


def tool_traffic(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off the conversations, which hold plain text only.

    Every assistant turn is a call that carries its text as an argument; the user turn
    after it is the result. Some calls are malformed, mistyped, incomplete or name an
    unknown tool, and in every fifth conversation calls stand before what they need.
    """
    turn, conv, text = F.col("turn"), F.col("conv_id"), F.col("text")
    length = F.length(text)
    kind = F.pmod(conv + turn, F.lit(10))
    arguments = (F.when(kind == 0, F.concat(F.lit('{"query": '), text))
                 .when(kind == 1, F.to_json(F.struct(text.alias("query"), length.cast("string").alias("limit"))))
                 .when(kind == 2, F.to_json(F.struct(length.alias("limit"))))
                 .when(kind == 3, F.to_json(F.struct(text.alias("query"), length.alias("limit"), F.lit(True).alias("deep"))))
                 .otherwise(F.to_json(F.struct(text.alias("query"), length.alias("limit")))))
    ahead = (F.pmod(conv, F.lit(5)) == 0) & (F.pmod(F.floor(turn / 2), F.lit(2)) == 0)
    needs = (F.when(ahead, F.array(F.concat(F.lit("c"), turn + 2)))
             .when(F.pmod(conv, F.lit(5)) == 0, F.array().cast("array<string>"))
             .otherwise(F.array(F.concat(F.lit("c"), turn - 2))))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("c"), turn).alias("call_id"), turn.alias("seq"),
        F.element_at(F.array(*map(F.lit, [*TOOLS, "browse"])), F.pmod(length, F.lit(4)).cast("int") + 1).alias("name"),
        arguments.alias("arguments"), needs.alias("depends_on"))
    results = turns.where("role = 'user' AND turn > 0").select(
        "conv_id", F.concat(F.lit("c"), turn - 1).alias("call_id"), turn.alias("seq"), text.alias("content"))
    return calls, results


@query
def op3_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return link_tool_calls(*tool_traffic(table(spark, folder, "conversations")), TOOLS)


@query
def op4_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"))


@query
def op5_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return stupid_backoff(table(spark, folder, "documents"), order=3)


@query
def op6_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return neighbour_fingerprints(docs, place_classes(docs))


@query
def op7_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: (phrase, label); fixed by the contract.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"), PHRASES).withColumn("n_spans", F.coalesce(F.size("spans"), F.lit(0))).drop("spans")


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents"), width=3, num=9, den=10)


#: (action, host and path prefix); fixed by the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


@query
def op10_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """The pages carry no labels: junk signs in their markup stand in for them."""
    return judge_urls(table(spark, folder, "pages"), markup_outcome(F.col("html")), URL_RULES)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten repeat a piece up to their end; fixed by the contract."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words), planted), F.lit(0))).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = longest_exponent(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), top.alias("top")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary_file("word_bpe_49k.json"))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_alignment(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))
