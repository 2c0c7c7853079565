"""Document fingerprints by spot signatures.

Wherever a common word (an anchor) stands, it and the CHAIN content words that follow make
a signature; the set of a text's signatures is its fingerprint. The beginning of a text
counts as an anchor, so every text with a word has one. Fingerprints are compared by
Jaccard similarity.

`neighbour_fingerprints` compares each document with an edited text that ends like the
next document, and with the next document itself (ascending doc_id; the first follows the
last). Documents are dealt into ranges of ids, sorted within them and read as a stream
that holds a few megabytes of text and one document more; the first document of each range
is also sent to the range before. That is the only shuffle of texts, which are compressed.

Null text counts as empty: no signature. Two empty fingerprints are alike (1), one empty
and one not are unlike (0). Null ids come first, in ranges of their own by a hash of the
text; documents of one doc_id follow each other by that hash. A single document is its own
next. Repeated rows each get their result. Extra columns are not returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import ALNUM, blocks, mix
from broadsheet.llm.common import ship_package, shuffle_partitions, text_bytes

CHAIN = 2
RANGE_BYTES = 32 << 20
MOST_RANGES = 20_000  #: ranges get larger beyond it; their bounds and first places are sent to all tasks
SLICE_BYTES = 2 << 20  #: of text compared at once
PLACE = ("null_id", "place")  #: where a row stands among all

#: Common words of four languages; fixed values.
ANCHORS = """
a about after all also an and are as at be been but by can do for from had has have he her his if in into is it its
more not of on one or she so than that the their them there they this to up was we were what when which who will with you
aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr
im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wie wir zu zum zur
al como con de del desde el ella en entre era es esta este ha hay la las le lo los mas me mi muy no nos o para pero por
que se ser si sin sobre son su sus también un una y ya
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
qui sa sans se ses son sont sur un une vous
"""


def signature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct signatures (32 bits) of each text."""
    anchors = np.unique(np.concatenate([b.hashes() for b in blocks(pa.array([ANCHORS]), ALNUM)]))
    for b in blocks(texts, ALNUM):
        words = b.hashes()
        of = b.word_docs()
        anchor = np.isin(words, anchors)
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        # The beginning of a text is an anchor before its first word.
        firsts = b.doc_words[:-1][np.diff(b.doc_words) > 0]
        place = np.concatenate([spots + 1, firsts])
        value = np.concatenate([words[spots], np.zeros(len(firsts), np.uint64)])
        doc = np.concatenate([of[spots], of[firsts]])
        next_content = np.searchsorted(content, place)
        for step in range(CHAIN):
            at = next_content + step
            inside = at < len(content)
            follow = content[np.minimum(at, max(len(content) - 1, 0))] if len(content) else np.zeros(len(at), np.int64)
            inside &= (of[follow] == doc) if len(of) else False
            value = mix(value * np.uint64(0x9E3779B97F4A7C15 | 1) + np.where(inside, words[follow] if len(words) else 0, np.uint64(step + 1)))
        order = np.argsort(doc, kind="stable")
        value = (value[order] >> np.uint64(32)).astype("<u4")
        cuts = np.searchsorted(doc[order], np.arange(b.docs + 1)).tolist()
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield np.unique(value[low:high])


def set_key(signatures: np.ndarray) -> bytes:
    """128 bits that tell distinct sets apart."""
    wide = signatures.astype(np.uint64)
    halves = [int(mix(wide + np.uint64(seed)).sum(dtype=np.uint64)) for seed in (1, 0x9E3779B97F4A7C15)]
    return b"".join(h.to_bytes(8, "big") for h in halves)


def encode(signatures: np.ndarray) -> str:
    """A fingerprint as text: base64 of the sorted 32-bit signatures."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def placed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), its hash, and its place: an id, or the hash where there is none."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"), F.col("doc_id").isNull().alias("null_id"),
                       F.coalesce("doc_id", F.xxhash64(text)).alias("place"))


class Ranges:
    """Ranges of places in order: null ids by their hash, then ids by sampled bounds."""

    def __init__(self, rows: DataFrame, number: int):
        self.number = number
        shares = [i / number for i in range(1, number)]
        self.bounds = np.array(sorted(set(rows.where("NOT null_id").approxQuantile("place", shares, 0.1 / number))), np.float64)

    def of(self, null_id: pa.Array, place: pa.Array) -> np.ndarray:
        places, none = np.asarray(place), np.asarray(null_id)
        by_hash = (places.astype(np.float64) / 2.0**64 + 0.5) * self.number
        return np.where(none, np.minimum(by_hash, self.number - 1), self.number + np.searchsorted(self.bounds, places.astype(np.float64), side="right")).astype(np.int32)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, n_signatures long, class_id long")


def _compared(rows: list[tuple], following: str) -> pa.RecordBatch:
    """Results of consecutive rows (doc_id, text, classes at its place); `following` is the text after them."""
    ids, texts = [r[0] for r in rows], [*(r[1] for r in rows), following]
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
    sets, changed = (list(signature_sets(pa.array(t, pa.string()))) for t in (texts, edited))
    classes = [r[2].get(set_key(s)) if len(s) else r[0] for r, s in zip(rows, sets)]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [encode(s) for s in sets[:-1]], "edited_fingerprint": [encode(s) for s in changed],
        "near_edited": [likeness(a, b) for a, b in zip(sets, changed)], "near_next": [likeness(a, b) for a, b in zip(sets, sets[1:])],
        "n_signatures": pa.array([len(s) for s in sets[:-1]], pa.int64()), "class_id": pa.array(classes, pa.int64())})


def neighbour_fingerprints(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    With `classes` (null_id, place, key, class_id; see `spotjoin.place_classes`) also class_id. They are
    dealt into the same ranges, ahead of their documents; a document without signatures is its own class.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = placed_rows(docs)
    ranges = Ranges(rows, min(max(shuffle_partitions(spark), -(-text_bytes(docs) // RANGE_BYTES)), MOST_RANGES))
    range_of = F.arrow_udf(lambda null_id, place: pa.array(ranges.of(null_id, place)), "int")

    # The first place of each range, no more rows than ranges: its rows also go to the range before.
    heads = sorted((r["range"], r["null_id"], r["head"]) for r in rows.select("null_id", range_of(*PLACE).alias("range"), "place")
                   .groupBy("range", "null_id").agg(F.min("place").alias("head")).collect())
    before = [(none, head, heads[i - 1][0]) for i, (_, none, head) in enumerate(heads)]
    extra = spark.createDataFrame(before, "null_id boolean, place long, also int")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            also = batch.column("also")
            part = np.concatenate([ranges.of(batch.column("null_id"), batch.column("place")), np.asarray(also.drop_null(), np.int32)])
            row = np.concatenate([np.arange(len(batch)), np.flatnonzero(np.asarray(also.is_valid()))])
            blobs = [pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in batch.column("text").cast(pa.large_binary())]
            taken = batch.select(["doc_id", "place", "tie"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.int32()), pa.array(np.arange(len(row)) >= len(batch)), *taken.columns,
                pa.array([blobs[i] for i in row], pa.binary()), pa.array(np.array([len(t.as_buffer()) for t in batch.column("text").cast(pa.large_binary())], np.int64)[row]),
                pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.int64())], names)

    schema = "part int, ahead boolean, doc_id long, place long, tie long, packed binary, size long, key binary, class_id long"
    names = [f.split()[0] for f in schema.split(", ")]
    dealt = rows.join(F.broadcast(extra), list(PLACE), "left").mapInArrow(deal, schema)
    if classes is not None:
        none = {"doc_id": "long", "tie": "long", "packed": "binary", "size": "long"}
        named = classes.select(range_of(*PLACE).alias("part"), F.lit(False).alias("ahead"), "place", "key", "class_id",
                               *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
        dealt = dealt.unionByName(named.select(*names))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, named, waiting, held = None, None, {}, [], 0
        for batch in batches:
            for p, ahead, doc_id, place, _, packed, size, key, class_id in zip(*(c.to_pylist() for c in batch.columns)):
                if part != p:
                    part, at, named = p, None, {}
                if at != place:
                    at, named = place, {}
                if packed is None:
                    named[key] = class_id
                    continue
                if ahead and not waiting:
                    continue  # of the next range's rows at its first place only the first is needed
                text = pa.decompress(packed, size, codec="zstd", asbytes=True).decode()
                if ahead or (waiting and held > SLICE_BYTES):
                    yield _compared(waiting, text)
                    waiting, held = [], 0
                if not ahead:
                    waiting.append((doc_id, text, named))
                    held += size
        pa.default_memory_pool().release_unused()

    parts = 2 * ranges.number if heads and heads[0][1] else ranges.number
    found = dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", "place", F.col("packed").isNotNull(), "tie").mapInArrow(stream, _SCHEMA)
    return found if classes is not None else found.drop("class_id")
