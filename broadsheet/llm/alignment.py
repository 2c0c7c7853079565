"""Alignment of two tokenizers by merging their token ends in lockstep.

Both cut the same bytes: a space and the text. Tokens of A and B are linked where their
byte ranges overlap; where both end, the tokens fall into groups. One state vector holds
the place in A and in B of many documents at once. Every step emits a link for each of
them, advances the side that ends first (both, with a cut, where they end together), and
drops documents that are done. A long document enters as several lanes that start at
common ends, so that no step is spent on one document alone.

How many documents hold a pair of ids linked is counted over all documents: a chunk of
documents sends each of its pairs once, totals are summed per pair, the highest total of
each id of A (no more rows than its vocabulary) is broadcast, and each chunk gets the
totals of its own pairs back. The links are kept per document as distinct pairs with their
numbers, in the shared folder, so texts are encoded once.

Null and empty texts, and those that a tokenizer changes (its tokens do not spell space +
text), have no tokens: zeros and ''. Repeated rows are documents of their own,
null ids stay. Empty tables give an empty result. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import gather, slices
from broadsheet.llm.common import ship_package, stored
from broadsheet.llm.vocabularies import byte_level, piece_bytes, sentence_pieces

BLOCK_BYTES = 2 << 20  #: of text merged at once; one document at least
CHUNK_BYTES = 16 << 20  #: of text that send their pairs together
LANE = 256  #: tokens of A after which a lane ends at the next common end

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Bytes:
    """Strings behind each other, to be gathered by number."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[gather(self.starts[numbers], self.lengths[numbers])]


class Side:
    """Tokens of a block of documents by one tokenizer."""

    def __init__(self, ids: list[np.ndarray], table: Bytes):
        self.ids = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        self.bounds = np.cumsum([0, *map(len, ids)])
        self.ends = np.cumsum(table.lengths[self.ids])
        self.table = table

    def document_ends(self) -> np.ndarray:
        return np.concatenate([[0], self.ends])[self.bounds]


def same_bytes(side: Side, texts: list[bytes]) -> np.ndarray:
    """Which documents' tokens spell their text."""
    got, want = np.diff(side.document_ends()), np.array([len(t) for t in texts], np.int64)
    right = got == want
    spelled = side.table.of(side.ids)
    if right.all():
        differs = np.concatenate([[0], np.cumsum(spelled != np.frombuffer(b"".join(texts), np.uint8))])
        ends = np.concatenate([[0], np.cumsum(want)])
        return differs[ends[1:]] == differs[ends[:-1]]
    ends = np.concatenate([[0], np.cumsum(got)])
    return np.array([r and spelled[a:b].tobytes() == t for r, a, b, t in zip(right, ends[:-1], ends[1:], texts)], bool)


def lanes(a: Side, b: Side, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token in A, first token in B, end in A) of stretches that start and end at common ends."""
    stops = [a.bounds[1:][np.diff(a.bounds) > 0]]
    at = np.concatenate([np.arange(lo + lane, hi, lane) for lo, hi in zip(a.bounds[:-1].tolist(), a.bounds[1:].tolist()) if hi - lo > lane] or [stops[0][:0]])
    while len(at):  # from each wanted stop on to the next common end
        place = np.minimum(np.searchsorted(b.ends, a.ends[at - 1]), len(b.ends) - 1)
        common = b.ends[place] == a.ends[at - 1]
        stops.append(at[common])
        at = at[~common] + 1
    stop = np.unique(np.concatenate(stops))
    start = np.concatenate([[0], stop]).astype(np.int64)[: len(stop)]
    first = np.searchsorted(b.ends, np.concatenate([[0], a.ends])[start], side="right")
    return start, first, stop


def merge(a: Side, b: Side, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A and B token of each link, A and B token at each cut), step by step."""
    at, bt, stop = lanes(a, b, lane)
    links_a, links_b, cuts_a, cuts_b = [at[:0]], [at[:0]], [at[:0]], [at[:0]]
    while len(at):
        links_a.append(at)
        links_b.append(bt)
        end_a, end_b = a.ends[at], b.ends[bt]
        cut = end_a == end_b
        cuts_a.append(at[cut])
        cuts_b.append(bt[cut])
        at = at + (end_a <= end_b)
        bt = bt + (end_b <= end_a)
        live = at < stop
        if not live.all():
            at, bt, stop = at[live], bt[live], stop[live]
    return tuple(map(np.concatenate, (links_a, links_b, cuts_a, cuts_b)))


_DIGITS = Bytes([str(i).encode() for i in range(1 << 16)] + [b",", b"|", b";"])
_COMMA, _BAR, _SEMICOLON = 1 << 16, (1 << 16) + 1, (1 << 16) + 2


def group_texts(a: Side, b: Side, cuts_a: np.ndarray, cuts_b: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2` of each document."""
    last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    last_a[cuts_a] = last_b[cuts_b] = True
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    through_a, through_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to each group's end
    before_b = np.concatenate([[0], through_b]).astype(np.int64)
    items = np.empty(2 * (len(a.ids) + len(b.ids)), np.int64)
    place = 2 * (np.arange(len(a.ids)) + before_b[of_a])
    items[place], items[place + 1] = a.ids, np.where(last_a, _BAR, _COMMA)
    place = 2 * (np.arange(len(b.ids)) + through_a[of_b])
    items[place], items[place + 1] = b.ids, np.where(last_b, _SEMICOLON, _COMMA)
    text = _DIGITS.of(items)
    upto = np.concatenate([[0], np.cumsum(_DIGITS.lengths[items])])
    ends = upto[2 * (a.bounds + b.bounds)].tolist()
    return [text[lo : hi - 1].tobytes() if hi > lo else b"" for lo, hi in zip(ends[:-1], ends[1:])]


def align(texts: list[str | None], a_path: str, b_path: str, tables: tuple[Bytes, Bytes]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of a block of texts; document, pair and number of each distinct link of a document)."""
    texts = [t or "" for t in texts]
    whole = [b" " + t.encode() for t in texts]
    ids_a = list(byte_level(a_path, plain=True).encode(" " + t if t else t for t in texts))
    ids_b = [np.array(x, np.int64) for x in sentence_pieces(b_path).encode(texts, num_threads=1)]
    wanted = [w if t else b"" for t, w in zip(texts, whole)]
    right = same_bytes(Side(ids_a, tables[0]), wanted) & same_bytes(Side(ids_b, tables[1]), wanted)
    a, b = (Side([x if ok else x[:0] for x, ok in zip(ids, right)], t) for ids, t in ((ids_a, tables[0]), (ids_b, tables[1])))
    links_a, links_b, cuts_a, cuts_b = merge(a, b)
    groups = group_texts(a, b, cuts_a, cuts_b)
    doc = np.searchsorted(a.bounds, links_a, side="right") - 1
    pairs, times = np.unique(doc.astype(np.uint64) << np.uint64(32) | (a.ids[links_a] << 16 | b.ids[links_b]).astype(np.uint64), return_counts=True)
    cut_docs = np.searchsorted(a.bounds, cuts_a, side="right") - 1
    columns = {"n_a": np.diff(a.bounds), "n_b": np.diff(b.bounds), "n_groups": np.bincount(cut_docs, minlength=len(texts)),
               "n_links": np.bincount(doc, minlength=len(texts)), "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups]}
    return columns, (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), times


def aligned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document with its counts and distinct pairs, and one per chunk (no `pairs`) with the pairs it holds.

    Columns: chunk, doc_id, the counts, groups_sha256, pairs (32 bits: A id, B id), times, held, docs.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Bytes(byte_level(a_path, plain=True).tokens), Bytes(piece_bytes(b_path))
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []

        def chunk_row() -> pa.RecordBatch:
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            return _rows(chunk, [None], {}, None, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes())

        for batch in batches:
            for first, last in slices(batch.column(1), block_bytes):
                texts = batch.column(1)[first:last].to_pylist()
                columns, doc, pairs, times = align(texts, a_path, b_path, tables)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                blobs = [(pairs[i:j].astype("<u4").tobytes(), times[i:j].astype("<u4").tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
                yield _rows(chunk, batch.column(0)[first:last], columns, blobs)
                held.append(pairs)
                size += sum(map(len, filter(None, texts)))
                if size >= chunk_bytes:
                    yield chunk_row()
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield chunk_row()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(task, _ALIGNED)


_ALIGNED = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs binary, times binary, held binary, docs binary")


def _rows(chunk: int, ids, columns: dict, blobs: list[tuple[bytes, bytes]] | None, held: bytes | None = None, docs: bytes | None = None) -> pa.RecordBatch:
    n = len(ids)
    pairs, times = zip(*blobs) if blobs else ([None] * n, [None] * n)
    given = {"chunk": pa.array([chunk] * n, pa.int64()), "doc_id": ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64())}
    given |= {c: pa.array(columns[c] if c in columns else [None] * n, pa.int64()) for c in COUNTS}
    given |= {"groups_sha256": pa.array(columns.get("groups_sha256", [None] * n), pa.string()), "pairs": pa.array(pairs, pa.binary()),
              "times": pa.array(times, pa.binary()), "held": pa.array([held] * n, pa.binary()), "docs": pa.array([docs] * n, pa.binary())}
    return pa.RecordBatch.from_pydict(given)


def link_counts(rows: DataFrame) -> DataFrame:
    """chunk, pair and docs: how many documents of the chunk hold the pair linked."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, docs in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, times = np.frombuffer(held, "<u4"), np.frombuffer(docs, "<u4")
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(pairs), chunk)), "pair": pa.array(pairs.astype(np.int64)),
                                                  "docs": pa.array(times.astype(np.int64))})

    return rows.where("held IS NOT NULL").select("chunk", "held", "docs").mapInArrow(unpack, "chunk long, pair long, docs long")


def corpus_alignment(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the
    numbers of documents that hold each link's pair, summed over the links.
    """
    ship_package(docs.sparkSession)
    rows = stored(aligned(docs, a_path, b_path, block_bytes, chunk_bytes), "aligned")
    counts = link_counts(rows)
    total = counts.groupBy("pair").agg(F.sum("docs").alias("total"))
    first_id = F.shiftright("pair", 16)
    highest = total.groupBy(first_id.alias("first")).agg(F.max("total").alias("highest"))  # no more rows than A has ids
    answers = (counts.select("chunk", "pair").join(total, "pair").join(F.broadcast(highest), first_id == F.col("first"))
               .select("chunk", "pair", "total", (F.col("total") == F.col("highest")).alias("best")))

    def rate(chunk: pa.Table, known: pa.Table) -> pa.Table:
        pair = known["pair"].to_numpy()
        order = np.argsort(pair)
        pair, total_, best = pair[order], known["total"].to_numpy()[order], known["best"].to_numpy()[order].astype(np.int64)
        n_best, sums = [], []
        for pairs, times in zip(chunk["pairs"].to_pylist(), chunk["times"].to_pylist()):
            at, n = np.searchsorted(pair, np.frombuffer(pairs, "<u4")), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int((best[at] * n).sum()))
            sums.append(int((total_[at] * n).sum()))
        return chunk.select(["doc_id", *COUNTS, "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(sums, pa.int64()))

    kept = rows.where("pairs IS NOT NULL").drop("held", "docs")
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        rate, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
