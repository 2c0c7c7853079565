"""Classes of documents with similar spot signatures.

Documents are linked when the Jaccard similarity of their signature sets is num / den or
more; classes are the components of the links. Documents with equal sets form a class at
once, so only distinct sets are compared.

Lengths are cut into ranges so that a set and a longer partner lie in the same range or in
neighbouring ones. A set is entered in its own range, and in the range below as the longer
partner, so every pair meets in one range only. There, two similar sets share a signature
among the first n - ceil(t n) + 1 of each, rarest first; how many sets hold a signature is
counted over all of them (`counting`), and signatures of one set alone are not entered.
Groups by range and signature are compared by counting shared signatures, shorter sets
with those no longer than den / num of their length only. Links that join two parts of a
group not yet joined leave the task, never all pairs; groups beyond BLOCK sets are split
into blocks, and every pair of blocks is a task of its own.

A task sends a set once, however many of its documents have it, and the sets meet in
chunks by a hash of their key. Texts are read twice: for the keys of all rows, which are
written, and for the sets.

Null or empty text: an empty set, linked with nothing, its own class. Repeated rows have
equal sets and the same class, also where one doc_id has several texts. A class is named
by its least doc_id; null doc_ids name none unless the class has no other. Empty tables
give an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import ship_package, stored
from broadsheet.llm.components import components
from broadsheet.llm.counting import chunk_of, layout, totals, with_totals
from broadsheet.llm.spotsigs import PLACE, placed_rows, set_key, signature_sets

BLOCK = 1000  #: sets of a group in one block
STRIP = 256  #: sets compared at a time
COLUMNS = 4096  #: signatures counted at a time
LONGEST = 1 << 40  #: no set is longer
SEEN = 200_000  #: keys of sets that a task remembers to have sent


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, its place, n and key of every row's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(signature_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(map(set_key, sets), pa.binary())], ["doc_id", *PLACE, "n", "key"])

    return placed_rows(docs).select("doc_id", "text", *PLACE).mapInArrow(sign, "doc_id long, null_id boolean, place long, n long, key binary")


def sent_sets(docs: DataFrame) -> DataFrame:
    """key and signatures (sorted, 32 bits each, little-endian) of the sets that are not empty; a task sends a set once or, rarely, again."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            keys, blobs = [], []
            for s in signature_sets(batch.column(0)):
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    blobs.append(s.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["key", "signatures"])

    return docs.select("text").mapInArrow(sign, "key binary, signatures binary")


def rare_heads(docs: DataFrame, num: int, den: int) -> DataFrame:
    """key, n, head, signatures of each distinct set that shares one of its first signatures, rarest first; `head` are those shared."""
    plan = layout(docs, 4, lean=True)
    chunked = sent_sets(docs).select(chunk_of(F.col("key"), plan).alias("chunk"), "key", "signatures")

    def sets_of(chunk: pa.Table) -> dict[bytes, np.ndarray]:
        return {k: np.frombuffer(s, "<u4").astype(np.uint64) << np.uint64(32) for k, s in zip(chunk["key"].to_pylist(), chunk["signatures"].to_pylist())}

    def keys_of(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(list(sets_of(chunk).values())), return_counts=True)

    def heads(chunk: pa.Table, total: np.ndarray) -> pa.Table:
        sets = sets_of(chunk)
        keys = np.unique(np.concatenate(list(sets.values())))
        out = []
        for key, s in sets.items():
            held = total[np.searchsorted(keys, s)]
            order = np.lexsort((s, held))[: len(s) - -(-num * len(s) // den) + 1]
            order = order[held[order] > 1]
            if len(order):
                short = (s >> np.uint64(32)).astype("<u4")
                out.append((key, len(s), short[order].astype(np.int64), short.tobytes()))
        key, n, head, blob = zip(*out) if out else ((), (), (), ())
        return pa.table({"key": pa.array(key, pa.binary()), "n": pa.array(n, pa.int64()), "head": pa.array(head, pa.list_(pa.int64())),
                         "signatures": pa.array(blob, pa.binary())})

    return with_totals(chunked, totals(chunked, keys_of, plan), heads, "key binary, n long, head array<long>, signatures binary", lean=True)


def length_bounds(num: int, den: int) -> list[int]:
    """First length of each range; a set's longer partners lie in its own range or the next."""
    bounds = [1]
    while bounds[-1] < LONGEST:
        bounds.append(bounds[-1] * den // num + 1)
    return bounds


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that join the parts of a group, of similarity num / den or more."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lengths = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    row = np.repeat(np.arange(len(order)), lengths)
    known, place, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[place] > 1  # what one set alone has is not counted
    renumber = np.cumsum(held > 1) - 1
    row, place = row[shared], renumber[place[shared]]
    by_column = np.argsort(place, kind="stable")
    row, place = row[by_column], place[by_column]
    width = int((held > 1).sum())
    root = np.arange(len(order))
    links = []
    for first in range(0, len(order), STRIP):
        last = min(first + STRIP, len(order))
        # Longer partners only, up to the length beyond which the bound is out of reach.
        end = int(np.searchsorted(lengths, lengths[last - 1] * den // num, side="right"))
        if len(np.unique(root[first:end])) == 1:
            continue
        overlap = np.zeros((last - first, end - first), np.float32)
        for low in range(0, width, COLUMNS):
            a, b = np.searchsorted(place, [low, low + COLUMNS])
            inside = (row[a:b] >= first) & (row[a:b] < end)
            holds = np.zeros((end - first, min(COLUMNS, width - low)), np.float32)
            holds[row[a:b][inside] - first, place[a:b][inside] - low] = 1
            overlap += holds[: last - first] @ holds.T
        both = lengths[first:last, None] + lengths[None, first:end]
        close = (num + den) * overlap.astype(np.int64) >= num * both
        for i in range(last - first):
            near = np.flatnonzero(close[i])
            for j in near[np.unique(root[first + near], return_index=True)[1]]:
                p, q = root[first + i], root[first + j]
                if p != q:
                    root[root == q] = p
                    links.append((order[first + i], order[first + j]))
    return links


def similarity_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) between keys of distinct sets (see `rare_heads`), enough to join every class."""
    bounds = F.array(*(F.lit(b) for b in length_bounds(num, den)))
    own = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    entries = sets.select("key", "head", F.explode(F.array(own, own - 1)).alias("range")).select("key", "range", F.explode("head").alias("signature"))
    group = ["range", "signature"]
    members = entries.groupBy(*group).agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("key")).alias("x"),
                                          F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("members > 1")
    # Of groups with the same members one is enough.
    kept = members.groupBy("range", "members", "x", "y").agg(F.min("signature").alias("signature"))
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = (entries.join(kept.select(*group, parts.alias("parts")), group)
              .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("key", *group, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")))
    task: list[str | Column] = [*group, "low", "high"]
    gathered = placed.join(sets.select("key", "signatures"), "key").repartition(*task).sortWithinPartitions(*task)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, blobs in _groups(batches):
            links = spanning_links([np.frombuffer(b, "<u4") for b in blobs], num, den)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in links], pa.binary()),
                                              pa.array([keys[j] for _, j in links], pa.binary())], ["a", "b"])

    return gathered.select(*task, "key", "signatures").mapInArrow(compare, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Runs of rows of one group and pair of blocks: about two blocks of sets at most."""
    current, keys, blobs = None, [], []
    for batch in batches:
        for *now, key, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if now != current:
                if len(keys) > 1:
                    yield keys, blobs
                current, keys, blobs = now, [], []
            keys.append(key)
            blobs.append(blob)
    if len(keys) > 1:
        yield keys, blobs


def key_classes(docs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """key, class_id of the distinct sets that are not empty; `rows` are the `row_keys` of the documents."""
    links = similarity_links(stored(rare_heads(docs, num, den), "sets"), num, den)
    found = components(links).select(F.col("node").alias("key"), "component")
    least = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = least.join(found, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("class_id"))
    return named.join(names, "component").select("key", "class_id")


def spot_classes(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_signatures, class_id of every document; see the head of the module."""
    ship_package(docs.sparkSession)
    rows = stored(row_keys(docs), "keys")
    return rows.join(key_classes(docs, rows, num, den), "key", "left").select(
        "doc_id", F.col("n").alias("n_signatures"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def place_classes(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """null_id, place, key, class_id: what `neighbour_fingerprints` takes as classes; a row for each set at a place."""
    ship_package(docs.sparkSession)
    rows = stored(row_keys(docs), "keys")
    held = rows.where("n > 0").select(*PLACE, "key").distinct()
    return held.join(key_classes(docs, rows, num, den), "key").select(*PLACE, "key", "class_id")
