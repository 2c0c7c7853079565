"""Stupid-backoff language-model scores, from counts of the rest of the corpus.

A word's score is the share of its n-gram among the occurrences of its context; where the
n-gram was never seen, it is `backoff` times the score with one word less of context. The
logs are summed per document. Counts leave the scored document out (its own n-grams would
always be found), so they are those of all other documents.

N-grams are exploded per chunk of documents, counted there, sent to the partition of their
hash, joined with the totals of that partition, and come back to be summed per document; see
`counting`. Words and pairs go first; each higher order follows with the n-grams whose parts
were both seen elsewhere, the others cannot be. Words are those between blanks, A-Z in lower case.

Null or empty text: no words, score 0, mean null. A word seen nowhere else scores as once in all
words. Repeated rows with one doc_id are documents of their own, and so find each other.
Empty tables give an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import SPACED, blocks, changes, mix, rolling, run_starts, sorted_places
from broadsheet.llm.counting import chunk_of, layout, phases, totals, with_totals

ALL_WORDS = np.uint64(0)  #: the key under which chunks send their number of words


def _ngrams(chunk: pa.Table, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each document; per order the keys of its n-grams and the word of the chunk that each ends with)."""
    texts = chunk["text"].combine_chunks()
    counts, found = np.zeros(len(texts), np.int64), [[] for _ in range(order)]
    before = 0
    for b in blocks(texts, SPACED):
        words = b.hashes()
        counts[b.first : b.first + b.docs] = np.diff(b.doc_words)
        for k in range(1, order + 1):
            starts, _ = run_starts(b.doc_words, k)
            keys = mix(rolling(words, k)[starts] + np.uint64(k)) if len(starts) else np.zeros(0, np.uint64)
            found[k - 1].append((keys, starts + (before + k - 1)))
        before += len(words)
    return counts, [tuple(map(np.concatenate, zip(*f))) if f else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for f in found]


def _look_up(chunk: pa.Table, order: int, totals_of: Callable[[int], np.ndarray], answered: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document; all words; per order and word how often its n-gram was seen elsewhere; keys and counts to ask next).

    Phase 0 asks for orders 1 and 2, each later phase for one order more. An n-gram can only be
    elsewhere if the two n-grams within it are, so others are not asked for. A phase's n-grams are
    sorted once, which puts those of one key together and, among them, those of one document.
    """
    words, grams = _ngrams(chunk, order)
    n = int(words.sum())
    owner = np.repeat(np.arange(order * len(words)), np.tile(words, order))
    seen = np.zeros((order, n), np.int64)
    every = 0
    keys = counts = np.zeros(0, np.int64)
    for phase, orders in enumerate([range(min(order, 2)), *([k] for k in range(2, order))]):
        kept = []
        for k in orders:
            gram, at = grams[k]
            if phase:
                open_ = (seen[k - 1, at] > 0) & (seen[k - 1, at - 1] > 0)
                gram, at = gram[open_], at[open_]
            kept.append((gram, k * n + at))
        gram, place = map(np.concatenate, zip(*kept))
        ranks, gram = sorted_places(gram)
        place = place[ranks]
        first = np.flatnonzero(changes(gram))
        keys, counts = gram[first], np.diff(first, append=len(gram))
        each = counts
        if not phase:
            real = keys != ALL_WORDS
            keys, counts = np.append(ALL_WORDS, keys[real]), np.append(n, counts[real])
        if phase == answered:
            break
        total = totals_of(phase)
        every = every if phase else int(total[0])
        own = np.diff(np.flatnonzero(changes(gram) | changes(owner[place])), append=len(gram))
        seen.reshape(-1)[place] = np.repeat(total[len(total) - len(each) :], each) - np.repeat(own, own)
    return words, every, seen, keys, counts


def stupid_backoff(docs: DataFrame, order: int = 2, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score and how many words needed a lower order."""
    plan = layout(docs, 6, lean=True)
    chunked = docs.select(chunk_of(F.coalesce("doc_id", F.xxhash64("text")), plan).alias("chunk"), "doc_id", "text")

    def asking(phase: int) -> Callable:
        def keys_of(chunk: pa.Table, totals_of: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
            return _look_up(chunk, min(order, phase + 2), totals_of, phase)[3:]

        return keys_of

    def score(chunk: pa.Table, totals_of: Callable) -> pa.Table:
        words, every, seen, _, _ = _look_up(chunk, order, totals_of, order)
        n = int(words.sum())
        of = np.repeat(np.arange(len(words)), words)
        place = np.arange(n) - (np.cumsum(words) - words)[of]
        rest = np.maximum(every - words, 0)[of]
        log = np.log(np.maximum(seen[0], 1) / np.maximum(rest, 1))
        for k in range(1, order):
            context = np.zeros(n, np.int64)
            context[1:] = seen[k - 1, :-1]
            hit = (place >= k) & (seen[k] > 0)
            log = np.where(hit, np.log(np.maximum(seen[k], 1) / np.maximum(context, 1)), np.where(place >= k, np.log(backoff) + log, log))
        lower = np.bincount(of[(place >= order - 1) & (seen[order - 1] <= 0)], minlength=len(words))
        sums = np.bincount(of, log, len(words))
        return pa.table({"doc_id": chunk["doc_id"], "n_words": pa.array(words), "log_score": pa.array(sums),
                         "mean_log_score": pa.array(sums / np.maximum(words, 1), mask=words == 0), "n_backoff": pa.array(lower)})

    replies = [totals(chunked, asking(0), plan)]
    for phase in range(1, order - 1):
        replies.append(totals(chunked, asking(phase), plan, phases(replies)))
    return with_totals(chunked, phases(replies), score,
                       "doc_id long, n_words long, log_score double, mean_log_score double, n_backoff long", plan)
