"""The order of keys and the look-up of n-grams in a chunk, against plain sorts and counts."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import bytewords, lm

MOST = (1 << 64) - 1


@pytest.mark.parametrize("keys", [[], [0], [MOST], [0, 0], [MOST, 0, MOST, 1], [5, 4, 5, 4, 7], [MOST, MOST - 1, MOST, MOST - 1, MOST - 2],
                                  [(i * 7919) % 50 << 40 | i % 3 for i in range(999)], [(i * 31) % 17 << (i % 60) for i in range(999)]])
def test_places_are_sorted_stably_where_leading_bits_agree(keys):
    keys = np.array(keys, np.uint64)
    order, ordered = bytewords.sorted_places(keys)
    right = np.argsort(keys, kind="stable")
    assert order.tolist() == right.tolist() and ordered.tolist() == keys[right].tolist()


def test_look_up_leaves_out_the_own_occurrences():
    texts = ["a b a b c", None, "", "b c", "a a a a", "a b a b c", "A b\tc"]
    words = [(t or "").lower().split() for t in texts]
    grams = [collections.Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)) for w in words]
    every = sum(grams, collections.Counter())
    chunk, totals = pa.table({"text": texts}), []
    for phase in range(2):
        totals.append(lm._look_up(chunk, 3, totals.__getitem__, phase)[4])  # this chunk is all there is
    n, all_words, seen, _, _ = lm._look_up(chunk, 3, totals.__getitem__, 3)
    assert n.tolist() == [len(w) for w in words] and all_words == sum(n)
    right = [[every[g] - own[g] if len(g) == k else 0 for w, own in zip(words, grams) for i in range(len(w)) for g in [tuple(w[max(i - k + 1, 0) : i + 1])]] for k in (1, 2, 3)]
    assert seen.tolist() == right


def test_look_up_takes_a_few_times_as_long_as_finding_the_ngrams():
    rng = np.random.default_rng(3)
    drawn = (200_000 * rng.random(600_000) ** 3).astype(int).astype(str).reshape(600, 1000)
    chunk = pa.table({"text": [" ".join(row) for row in drawn]})
    totals = []
    for phase in range(2):
        totals.append(lm._look_up(chunk, 3, totals.__getitem__, phase)[4] + 1)

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    found = min(seconds(lambda: lm._ngrams(chunk, 3)) for _ in range(4))
    looked_up = min(seconds(lambda: lm._look_up(chunk, 3, totals.__getitem__, 3)) for _ in range(4))
    assert looked_up < 5 * found, (looked_up, found)
