"""Toxicity by multiple-instance learning: sentences explain the label of their document.

A sentence's probability is logistic in the weights of its features; a document is toxic
if any sentence is (noisy-or), 1 - prod(1 - p). Only document labels are known; the
gradient of the document's likelihood shares the blame among its sentences, and the
sentence probabilities then locate the offending ones.

Features are hashes of words and of their first 4, 5 and 6 bytes, in lower case. The model
is fitted on about `train_docs` labelled documents (all if there are fewer; chosen by a
hash of the id), so the label rows that meet the documents are of bounded number and are
broadcast; no text is shuffled. Spark counts in how many toxic and other documents of that
sample each feature occurs; those that tell the two apart (likelihood ratio) are kept,
MOST_FEATURES at most. Weights are fitted on the driver from the sample's kept features.
Those bounds are the model's; scores read whole texts.

Null or empty text: no sentence, score 0. Without labels of both kinds every score is 0.
Repeated rows get equal results; extra columns are not returned. Where a document has
several labels, it counts as toxic if one says so; null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import ALNUM, Block, blocks

BITS = 22  #: of a feature's hash
MOST_FEATURES = 4096
PREFIXES = (4, 5, 6)
_STOP = np.isin(np.arange(256), [0x0A, 0x21, 0x2E, 0x3F])


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of all words and their beginnings."""
    whole = np.arange(len(b.starts))
    found, words = [b.hashes()], [whole]
    for n in PREFIXES:
        longer = whole[b.ends - b.starts >= n]
        found.append(b.hashes(b.starts[longer], b.starts[longer] + n) ^ np.uint64(n))
        words.append(longer)
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(words)


def sentences(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(sentence of each word, byte offsets of the sentences and the end)."""
    opens = np.zeros(len(b.data) + 1, dtype=bool)
    opens[1:] = _STOP[b.data]
    opens[b.bounds] = True
    starts = np.flatnonzero(opens)
    return np.searchsorted(starts, b.starts, side="right") - 1, starts


@dataclass
class Model:
    keys: np.ndarray  #: sorted kept features
    weights: np.ndarray
    bias: float

    def known(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(index among the kept features, word) of a block's kept features."""
        found, words = features(b)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[at] == found
        return at[hit], words[hit]


def bags(b: Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept feature, sentence) pairs, each once; sentence starts; sentences that hold words."""
    sentence, starts = sentences(b)
    at, words = model.known(b)
    pairs = np.unique(sentence[words].astype(np.int64) * len(model.keys) + at)
    return pairs % len(model.keys), pairs // len(model.keys), starts, np.unique(sentence)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 20_000, steps: int = 150) -> Model:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    everyone = known.count()
    share = min(1.0, train_docs / max(everyone, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each kind with each feature, summed over a task."""
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            toxic = np.asarray(batch.column(2)) > 0
            for b in blocks(batch.column(1), ALNUM):
                found, words = features(b)
                pairs = np.unique((b.word_docs()[words].astype(np.int64) << BITS) | found)
                kind = toxic[b.first + (pairs >> BITS)].astype(np.int64)
                counts += np.bincount((kind << BITS) | (pairs & ((1 << BITS) - 1)), minlength=2 << BITS).reshape(2, -1).astype(np.int32)
        seen = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1, seen].astype(np.int64)),
                                          pa.array(counts[0, seen].astype(np.int64))], ["feature", "with", "without"])

    sizes = {bool(k): n for k, n in rows.groupBy(F.col("toxic") > 0).count().collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    if not positive or not negative:
        return Model(np.zeros(1, np.int64), np.zeros(1), -50.0)
    table = rows.mapInArrow(occurrences, "feature long, with long, without long").groupBy("feature").agg(
        F.sum("with").cast("double").alias("a"), F.sum("without").cast("double").alias("b"))
    everyone = positive + negative
    term = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    both = F.col("a") + F.col("b")
    ratio = 2 * (term(F.col("a"), both * positive / everyone) + term(F.col("b"), both * negative / everyone)
                 + term(positive - F.col("a"), (everyone - both) * positive / everyone)
                 + term(negative - F.col("b"), (everyone - both) * negative / everyone))
    kept = (table.where("a >= 3").withColumn("ratio", ratio).where("ratio > 15")
            .select("feature", "ratio").orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES).toPandas())
    keys = np.sort(kept["feature"].to_numpy(np.int64))
    if not len(keys):
        return Model(np.zeros(1, np.int64), np.zeros(1), float(np.log(positive / everyone)))
    return train(rows, Model(keys, np.zeros(len(keys)), -6.0), steps)


def train(rows: DataFrame, model: Model, steps: int) -> Model:
    """Fit weights by gradient ascent on the noisy-or likelihood of the documents."""

    def kept_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0), ALNUM):
                at, sentence, starts, with_words = bags(b, model)
                doc = np.searchsorted(b.bounds, starts[sentence], side="right") - 1
                of = np.searchsorted(b.bounds, starts[with_words], side="right") - 1
                cut = pa.array(np.searchsorted(doc, np.arange(b.docs + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(1)[b.first : b.first + b.docs], pa.array(np.bincount(of, minlength=b.docs)),
                    pa.ListArray.from_arrays(cut, pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(sentence.astype(np.int32)))], ["toxic", "n", "at", "sentence"])

    read = rows.select("text", "toxic").mapInArrow(
        kept_features, "toxic long, n long, at array<int>, sentence array<int>").toArrow()
    toxic = np.asarray(read["toxic"]) > 0
    at = read["at"].combine_chunks()
    feature, lengths = np.asarray(at.flatten()), np.asarray(at.value_lengths())
    doc = np.repeat(np.arange(len(toxic)), lengths)
    raw = np.asarray(read["sentence"].combine_chunks().flatten()).astype(np.int64)
    _, sentence = np.unique(doc.astype(np.int64) << 32 | raw, return_inverse=True)
    of = np.zeros(int(sentence.max()) + 1 if len(sentence) else 0, np.int64)
    of[sentence] = doc
    blank = np.asarray(read["n"]) - np.bincount(of, minlength=len(toxic))
    theta = np.append(model.weights, model.bias)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias = theta[:-1], theta[-1]
        z = bias + np.bincount(sentence, w[feature], len(of))
        rest = blank * np.logaddexp(0, bias)
        s = np.bincount(of, np.logaddexp(0, z), len(toxic)) + rest
        # d log likelihood / d log(1 - p): -1 for a clean document, exp(-s) / (1 - exp(-s)) for a toxic one
        blame = np.where(toxic, 1 / np.maximum(np.expm1(np.minimum(s, 500)), 1e-12), -1.0)
        g = blame[of] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(feature, g[sentence], len(w)), g.sum() + (blame * blank).sum() / (1 + np.exp(-bias)))
        gradient = gradient / len(toxic) - np.append(1e-5 * w, 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(model.keys, theta[:-1], float(theta[-1]))


SCORED = "score double, offending array<struct<start: int, length: int, score: double>>"


def score(docs: DataFrame, model: Model, keep=("doc_id",), least: float = 0.1) -> DataFrame:
    """The kept columns, score, and the offending sentences (characters) of every document.

    A sentence is listed if its own probability reaches `least`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES weights

    @F.arrow_udf(SCORED)
    def rate(texts: pa.Array) -> pa.Array:
        m, scores, listed = shared.value, [], []
        for b in blocks(texts, ALNUM):
            at, sentence, starts, with_words = bags(b, m)
            z = m.bias + np.bincount(sentence, m.weights[at], len(starts))
            doc = np.searchsorted(b.bounds, starts[with_words], side="right") - 1
            scores.append(-np.expm1(-np.bincount(doc, np.logaddexp(0, z[with_words]), b.docs)))
            p = 1 / (1 + np.exp(-z))
            named = with_words[p[with_words] >= least]
            chars = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
            begin, end = chars[starts[named]], chars[starts[named + 1]]
            owner = np.searchsorted(b.bounds, starts[named], side="right") - 1
            rows = pa.StructArray.from_arrays([
                pa.array((begin - chars[b.bounds[owner]]).astype(np.int32)), pa.array((end - begin).astype(np.int32)),
                pa.array(p[named])], ["start", "length", "score"])
            listed.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(b.docs + 1)), pa.int32()), rows))
        if not scores:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
            return pa.StructArray.from_arrays([pa.array([], pa.float64()), pa.array([], kind)], ["score", "offending"])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.concat_arrays(listed)], ["score", "offending"])

    scored = docs.select(*keep, rate(F.col("text")).alias("rated"))
    names = [c for c in scored.columns if c != "rated"]
    return scored.select(*names, F.col("rated.score").alias("score"), F.col("rated.offending").alias("offending"))
