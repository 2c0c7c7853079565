"""License scans by diagonal voting.

Every run of K words of every text is hashed; the hashes meet the positions of the
license templates in a join. A match at document word p and template word t votes for the
diagonal p - t. Votes are counted per document, license and diagonal, neighbouring
diagonals (words left out or put in) are merged, and a merged span counts if it covers
enough of its template. Phrases are found in the same pass as places where their words
stand consecutively, and their labels always stay.

The hashes of the templates (a fixed list of notices, MAX_GRAMS at most, so safe to
broadcast) are tested while the text is read: only hashes that can meet the join leave the
task. All grouping is by document; a notice in a third of all documents is a third of the
documents' own small groups.

Null or empty text: no words, no labels, score 0. Repeated rows and null ids each get their
result.
Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from broadsheet.llm.bytewords import ALNUM, blocks, rolling, run_starts

K = 3  #: words in a gram
MAX_GRAMS = 100_000

#: Notices by label; fixed values, words of public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

SCHEMA = ("doc_id long, row_key long, n_words long, n_base long, first_word long, last_word long, "
          "base array<string>, hits array<struct<gram: long, at: int>>")


def words_of(text: str) -> np.ndarray:
    return np.concatenate([b.hashes() for b in blocks(pa.array([text]), ALNUM)])


def template_grams(templates: list[tuple[str, str]]) -> list[tuple[int, int, str, int, int]]:
    """(template, length in words, label, gram, position) of every run of K words."""
    rows = []
    for n, (label, text) in enumerate(templates):
        words = words_of(text)
        if len(words) < K:
            raise ValueError(f"a template has {K} words at least: {text!r}")
        rows += [(n, len(words), label, int(g), t) for t, g in enumerate(rolling(words, K).view(np.int64))]
    if len(rows) > MAX_GRAMS:
        raise ValueError("the templates are too long to be broadcast")
    return rows


def scan(docs: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str]] = TEMPLATES,
         slack: int = 2, coverage: float = 0.6) -> DataFrame:
    """Per document: words, places of phrases, labels, score and the verified spans.

    Diagonals at most `slack` apart are merged; a span counts from `coverage` of its
    template's words.
    """
    spark = docs.sparkSession
    grams = template_grams(templates)
    known = np.unique(np.array([g[3] for g in grams], dtype=np.int64))
    sought = [(len(words_of(p)), rolling(words_of(p), len(words_of(p)))[0], label) for p, label in phrases]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for b in blocks(batch.column(2), ALNUM):
                words = b.hashes()
                starts, runs = run_starts(b.doc_words, K)
                hashed = rolling(words, K).view(np.int64)[starts]
                hit = np.flatnonzero(np.isin(hashed, known))
                of = np.repeat(np.arange(b.docs), runs)[hit]
                hits = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(b.docs + 1)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(hashed[hit]), pa.array((starts[hit] - b.doc_words[of]).astype(np.int32))], ["gram", "at"]))
                count = np.zeros(b.docs, np.int64)
                first = np.full(b.docs, np.iinfo(np.int64).max)
                last = np.full(b.docs, -1, np.int64)
                labels: list[set[str]] = [set() for _ in range(b.docs)]
                for width, value, label in sought:
                    at, n = run_starts(b.doc_words, width)
                    found = np.flatnonzero(rolling(words, width)[at] == value)
                    docs_at = np.repeat(np.arange(b.docs), n)[found]
                    place = at[found] - b.doc_words[docs_at]
                    np.add.at(count, docs_at, 1)
                    np.minimum.at(first, docs_at, place)
                    np.maximum.at(last, docs_at, place)
                    for d in np.unique(docs_at):
                        labels[d].add(label)
                part = slice(b.first, b.first + b.docs)
                yield pa.RecordBatch.from_arrays([
                    ids[part], keys[part], pa.array(np.diff(b.doc_words)), pa.array(count),
                    pa.array(first, mask=count == 0), pa.array(last, mask=count == 0),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())), hits],
                    ["doc_id", "row_key", "n_words", "n_base", "first_word", "last_word", "base", "hits"])

    read = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(find, SCHEMA)
    positions = spark.createDataFrame(grams, "template int, length int, label string, gram long, t int")
    votes = (read.where(F.size("hits") > 0).select("doc_id", "row_key", F.inline("hits"))
             .join(F.broadcast(positions), "gram")
             .groupBy("doc_id", "row_key", "template", "length", "label", (F.col("at") - F.col("t")).alias("diagonal"))
             .agg(F.collect_set("t").alias("ts"), F.min("at").alias("low"), F.max("at").alias("high")))
    # The few diagonals of one document and template, in order; a wide gap opens a new span.
    line = W.Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    opens = F.col("diagonal") - F.lag("diagonal").over(line) > slack
    spans = (votes.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int"))
             .withColumn("span", F.sum("opens").over(line))
             .groupBy("doc_id", "row_key", "template", "length", "label", "span")
             .agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"),
                  F.min("low").cast("long").alias("start"), (F.max("high") + K).cast("long").alias("stop")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (K - 1))))))
    verified = (spans.withColumn("score", covered / F.col("length")).where(F.col("score") >= coverage)
                .groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"))
                .agg(F.max("score").alias("score"), F.collect_set("label").alias("found"),
                     F.array_sort(F.collect_list(F.struct("start", "stop", "label", "score"))).alias("spans")))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.coalesce("score", F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key"))
    return read.drop("hits").join(verified, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")
