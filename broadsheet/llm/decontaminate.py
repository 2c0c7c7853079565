"""Benchmark decontamination by greedy string tiling.

Runs of K words of a document (hashed as Karp and Rabin do) that also occur in a test item
are seeds; they meet the item's places in a join. Per document and item, seeds that follow
each other on a diagonal are matches; the longest match is marked, what it overlaps is cut
back, and so on until none of K words is left. The share of an item's words under tiles
is its coverage. Tiles may stand in any order, so a reordered passage is covered as well.

The benchmark is the query set: it is taken in blocks of at most BLOCK_WORDS words, each
small enough to be broadcast and to be tested while the texts are read, so only seeds
leave the tasks. Seeds are grouped by document and item; a passage that many documents
share is many small groups.

Null or empty text and documents of less than K words have no seeds: coverage 0, not
contaminated. Items of less than K words, or without text, are never found. Repeated rows
get equal results, null ids their own. An empty benchmark or table gives no finding. Of items with equal
coverage the least id is named. Extra columns are not returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import ALNUM, blocks, rolling, run_starts
from broadsheet.llm.common import stored

K = 4  #: words of the shortest match
BLOCK_WORDS = 200_000  #: words of the benchmark in one block


def tile(at: np.ndarray, item_at: np.ndarray, length: int, k: int = K) -> list[tuple[int, int, int]]:
    """(document word, item word, words) of the tiles over seeds (at, item_at)."""
    diagonal = at - item_at
    order = np.lexsort((at, diagonal))
    at, diagonal = at[order], diagonal[order]
    opens = np.flatnonzero(np.r_[True, (np.diff(diagonal) != 0) | (np.diff(at) != 1)])
    runs = np.diff(np.append(opens, len(at)))
    heap = [(-(int(n) + k - 1), int(at[i] - diagonal[i]), int(at[i])) for i, n in zip(opens, runs)]
    heapq.heapify(heap)
    used, used_item, tiles = set(), set(), []
    while heap and len(used_item) < length:
        negative, t, p = heapq.heappop(heap)
        free = [p + j not in used and t + j not in used_item for j in range(-negative)]
        if all(free):
            used.update(range(p, p - negative))
            used_item.update(range(t, t - negative))
            tiles.append((p, t, -negative))
            continue
        start = None  # cut back to the parts that are still free
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= k:
                    heapq.heappush(heap, (start - j, t + start, p + start))
                start = None
    return tiles


def item_grams(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, gram, item_at of every run of K words of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), ALNUM):
                starts, runs = run_starts(b.doc_words, K)
                of = np.repeat(np.arange(b.docs), runs)
                grams = rolling(b.hashes(), K)[starts] if len(starts) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(b.first + of)), pa.array(np.diff(b.doc_words)[of]), pa.array(grams.view(np.int64)),
                     pa.array((starts - b.doc_words[of]).astype(np.int32))], ["item_id", "n_words", "gram", "item_at"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, n_words long, gram long, item_at int")


def seeds(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, row_key, gram, at of every run of K words that is among the known."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2), ALNUM):
                starts, runs = run_starts(b.doc_words, K)
                if not len(starts):
                    continue
                grams = rolling(b.hashes(), K).view(np.int64)[starts]
                hit = np.flatnonzero(np.isin(grams, known))
                of = np.repeat(np.arange(b.docs), runs)[hit]
                rows = pa.array(b.first + of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(grams[hit]),
                     pa.array((starts[hit] - b.doc_words[of]).astype(np.int32))], ["doc_id", "row_key", "gram", "at"])

    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(find, "doc_id long, row_key long, gram long, at int")


def _tiled(at: pa.Array, item_at: pa.Array, length: pa.Array) -> pa.Array:
    covered, count = [], []
    for a, t, n in zip(at, item_at, length.to_pylist()):
        found = tile(a.values.to_numpy(zero_copy_only=False).astype(np.int64), t.values.to_numpy(zero_copy_only=False).astype(np.int64), n)
        covered.append(sum(w for *_, w in found))
        count.append(len(found))
    return pa.StructArray.from_arrays([pa.array(covered, pa.int32()), pa.array(count, pa.int32())], ["covered", "tiles"])


def findings(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """doc_id, row_key, item_id, coverage, tiles of every document and item from the threshold on."""
    grams = stored(item_grams(benchmark), "items")
    words = grams.select("item_id", "n_words").distinct().agg(F.sum("n_words")).first()[0] or 0
    parts = -(-words // BLOCK_WORDS) or 1
    tiled = F.arrow_udf(_tiled, "struct<covered: int, tiles: int>")
    found = []
    for part in range(parts):
        block = grams.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        known = block.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)  # at most about BLOCK_WORDS
        places = F.collect_set(F.struct("at", "item_at"))
        pairs = (seeds(docs, known).join(F.broadcast(block), "gram")
                 .groupBy("doc_id", "row_key", "item_id", "n_words").agg(places.alias("places"))
                 # No more words can be covered than K for each place of the item that has a seed.
                 .where(K * F.size(F.array_distinct("places.item_at")) >= threshold * F.col("n_words")))
        rated = pairs.withColumn("tiled", tiled(F.col("places.at"), F.col("places.item_at"), F.col("n_words")))
        found.append(rated.select("doc_id", "row_key", "item_id", (F.col("tiled.covered") / F.col("n_words")).alias("coverage"), "tiled.tiles"))
    return reduce(DataFrame.unionByName, found).where(F.col("coverage") >= threshold)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per document: contaminated, the item covered most, its coverage and tiles, and how many items."""
    best = F.max_by(F.struct("item_id", "coverage", "tiles"), F.struct("coverage", -F.col("item_id")))
    per_doc = findings(docs, benchmark, threshold).groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).agg(
        best.alias("best"), F.count("*").alias("n_items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"))
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key")), "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.col("best.item_id").alias("item_id"),
        F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("best.tiles", F.lit(0)).alias("n_tiles"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The documents without a finding, all columns."""
    found = findings(docs, benchmark, threshold).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left_anti")
