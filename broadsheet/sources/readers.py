"""Readers. CSV cells are read as text and missing-value markers become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.labels import csv_missing_to_null
from broadsheet.functions.text import let, strip
from broadsheet.operators.curation import header_normalise, terms_from_lines
from broadsheet.sources.records import records, split_cells
from broadsheet.storage import stored

INDEX_SCHEMA = "url string, filename string, offset string, length string, collection string"
BLOCK_FIELDS = ("url", "year", "source", "state")


def row_position() -> Column:
    """Place of a row in its input: file, block of the file, row within the task.

    Sorting by it gives file order without numbering all rows in one task. It is
    the same when a lost task runs again.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file or folder as text columns plus ``row_pos``, the number of the row.

    Quoted cells may hold line breaks; files are split between tasks all the same
    (see `records`). With ``multi_line`` off every line is a row.
    """
    names = spark.read.csv(path, header=True, escape='"', multiLine=multi_line).columns
    fields = ", ".join(f"_{i} string" for i in range(len(names)))
    options = {"escape": '"', "multiLine": "true", "maxColumns": str(max(20480, len(names)))}
    rows = records(spark, path, quoted=multi_line).where("NOT is_header")
    # Filters are not pushed through a generator, so a record is parsed once.
    parsed = rows.select("row_pos", F.inline(F.array(F.from_csv("record", fields, options))))
    cells_ = [csv_missing_to_null(F.col(f"_{i}")).alias(c) for i, c in enumerate(names)]
    return parsed.select(*cells_, "row_pos")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A keyword file as ``term`` rows."""
    return terms_from_lines(spark.read.text(path))


def load_terms(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """The distinct terms of a keyword file, for the operators' term parameters.

    A dictionary becomes part of the plan, so it has to be small; a file with
    more than ``most`` terms is an error, never cut.
    """
    terms = read_terms(spark, path).distinct().limit(most + 1).collect()
    if len(terms) > most:
        raise ValueError(f"more than {most} terms in {path}")
    return tuple(sorted(r.term for r in terms))


def read_sources(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Source inventory; ``source_id`` tells its rows apart."""
    rows = read_csv(spark, path, multi_line).withColumnRenamed("row_pos", "source_id")
    if "ideology" in rows.columns:
        rows = rows.withColumn("ideology", F.col("ideology").cast("double"))
    return rows


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines index records; records without a URL are skipped.

    The collection is a field of the record or a ``collection=…`` folder, which
    lets a join on it prune whole folders.
    """
    return index_records(spark.read.schema(INDEX_SCHEMA).json(path), row_position().alias("index_pos"))


def read_crawl_table(spark: SparkSession, path: str) -> DataFrame:
    """What `write_crawl_index` wrote, with the ``host`` of each record."""
    return spark.read.parquet(path)


def crawl_index_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Index records of files that arrive over time, with their ``file`` and ``block``; see `streaming.collect`."""
    records = spark.readStream.schema(INDEX_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return index_records(records, *place)


def index_records(records: DataFrame, *place: Column) -> DataFrame:
    return records.where(F.col("url").isNotNull()).select(
        "url",
        "filename",
        F.col("offset").cast("bigint").alias("offset"),
        F.col("length").cast("bigint").alias("length"),
        "collection",
        *place,
    )


def read_article_blocks(spark: SparkSession, path: str, newline: str = "\n") -> DataFrame:
    """Articles from block text, split between tasks at the separator lines.

    Give ``newline="\\r\\n"`` for files with such line ends.
    """
    lines = spark.read.option("lineSep", f"{newline}---{newline}").text(path)
    return parse_article_blocks(lines)


def parse_article_blocks(blocks: DataFrame, block: str = "value") -> DataFrame:
    """``url, year, source, state, text`` of each block that is not blank.

    The text is what follows the first ``text:`` line. Of a repeated header
    line the last counts; other lines are ignored.
    """
    plain = F.regexp_replace(block, "\r\n?", "\n")
    mark = "text:\n"
    at = F.locate(mark, F.col("_block"))
    header = F.when(at > 0, F.substr("_block", F.lit(1), at - 1)).otherwise(F.col("_block"))
    text = F.when(at > 0, strip(F.substr("_block", at + len(mark)))).otherwise("")
    split_blocks = (
        blocks.select(plain.alias("_block"))
        .where(strip(F.col("_block")) != "")
        .select(F.regexp_replace(header, _LINE_END, "\n").alias("_header"), text.alias("text"))
    )
    fields = [_header_field(F.col("_header"), name).alias(name) for name in BLOCK_FIELDS]
    articles = split_blocks.select(*fields, "text")
    return articles.withColumn("year", F.col("year").try_cast("int"))


# Line ends that separate header lines beside the plain line feed.
_LINE_END = "[\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _header_field(header: Column, name: str) -> Column:
    """Stripped value of the last ``name:`` line; null without one."""
    values = F.regexp_extract_all(header, F.lit(rf"(?:^|\n){name}:([^\n]*)"), F.lit(1))
    return let(values, lambda found: strip(F.try_element_at(found, F.lit(-1))))


def read_people(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Model annotations, one row per person. A missing article id is an error."""
    rows = read_csv(spark, path, multi_line)
    # Whole numbers directly: a double would merge ids above 2^53.
    number = F.coalesce(F.col("article_id").try_cast("bigint"), F.col("article_id").cast("double").cast("bigint"))
    missing = F.raise_error(F.lit("person without article_id")).cast("bigint")
    return rows.withColumn("art_num", F.coalesce(number, missing))


def read_survey(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One survey export file as a wide sheet. The question texts under the header are dropped."""
    return read_csv(spark, path, multi_line).where(F.col("row_pos") > 1)


def read_survey_cells(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Survey exports in long form: ``file_pos, row_pos, pos, col, value``, a row for each cell.

    However many columns a sheet has, the plan is the same: cells are split off by position
    and get their names from the cells of their file's header. A folder may hold several
    exports with headers of their own. Question texts under the headers are dropped.

    Whole records meet their header, so no single cell is shuffled. The cells are written to
    the shared folder, as they are used several times.
    """
    every = stored(split_cells(records(spark, path, quoted=multi_line).where("row_pos <> file_pos + 1")), "sheets")
    names = every.where("is_header").select("file_pos", F.col("cells").alias("names"))
    rows = every.where("NOT is_header").join(names, "file_pos")
    # Cells beyond the header have no name and are left out, as are names beyond the cells.
    common = F.least(F.size("names"), F.size("cells"))
    pairs = F.arrays_zip(F.slice("names", 1, common).alias("col"), F.slice("cells", 1, common).alias("value"))
    spread = rows.select("file_pos", "row_pos", F.posexplode(pairs).alias("pos", "cell"))
    return stored(spread.select("file_pos", "row_pos", "pos", "cell.col", csv_missing_to_null(F.col("cell.value")).alias("value")), "cells")


def read_curated_metadata(
    spark: SparkSession, path: str, multi_line: bool = True
) -> DataFrame:
    rows = header_normalise(read_csv(spark, path, multi_line).drop("row_pos"))
    return rows.withColumn("year", F.col("year").try_cast("int"))


def read_race_counts(
    spark: SparkSession, path: str, multi_line: bool = True
) -> DataFrame:
    rows = read_csv(spark, path, multi_line).drop("row_pos")
    return rows.withColumn("count", F.col("count").cast("bigint"))
