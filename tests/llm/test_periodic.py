"""Periodic runs against a search over all periods."""

import fractions
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from broadsheet.llm import periodic
from broadsheet.llm.bytewords import mix
from broadsheet.llm.queries import QUERIES

LONG = "one two three " * 7000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a a a a a a"), (5, "a a a a a a"), (6, "a a a a a"), (7, "A a A a A a A a"), (None, "x y z " * 5),
       (8, "日 本\x0b日 本\n日 本\t日 本\x0c!"), (9, "\x1c \x85 \x1c \x85 \x1c \x85 \x1c \x85"), (20, "p q r s"), (21, " lead " + "k " * 9)]


def search(words, least_length=6, least_exponent=4):
    """Every maximal stretch that repeats at a distance, unless it also does at a smaller one."""
    found = set()
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least_length, least_exponent * q) and not any(words[i : i + n - r] == words[i + r : i + n] for r in range(1, q)):
                found.add((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_with_runs(rng):
    docs = []
    for _ in range(rng.randint(0, 4)):
        letters, words = rng.choice([1, 2, 3, 5, 30]), []
        for _ in range(rng.randint(0, 6)):
            piece = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([2, 5, 12])))]
            whole = piece * rng.choice([1, 1, 2, 4, 5, 9])
            words += whole[: rng.randint(1, len(whole))] if rng.random() < 0.5 else whole
        docs.append(words)
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_the_search(seed):
    rng = random.Random(seed)
    for _ in range(700):
        docs = texts_with_runs(rng)
        flat, bounds = np.array([w for d in docs for w in d], np.uint64), np.cumsum([0, *map(len, docs)])
        assert periodic.block_runs(mix(flat + np.uint64(1)), bounds) == [search(d) for d in docs]
        assert periodic.block_runs(flat, bounds, 11, 5) == [search(d, 11, 5) for d in docs]
        for d, low, high in zip(docs, bounds[:-1].tolist(), bounds[1:].tolist()):  # the automaton on whole texts, without candidates
            if d:
                assert sorted((s - low, n, q) for s, n, q in periodic.runs_in(flat, low, high - 1, low, high)) == sorted(search(d))


def test_segments_are_longest_agreements():
    """Every place met with l words agrees on them, and the nearest place for every length is met."""
    rng = random.Random(9)
    for _ in range(60):
        words = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        automaton = periodic.Automaton()
        for i, w in enumerate(words):
            met = {p: n for p, n in automaton.append(w, i) if n}
            agree = {p: next((k for k in range(p + 1) if words[p - k] != words[i - k]), p + 1) for p in range(i)}
            nearest, longest = {}, 0
            for p in range(i - 1, -1, -1):
                if agree[p] > longest:
                    nearest[p] = longest = agree[p]
            assert met == nearest


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.block_runs(np.zeros(9, np.uint64), np.array([0, 9]), 6, 3)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = search(words) if n < 3000 else [(0, n, 3)] if text == LONG else None
    if runs is None:
        return None
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_the_contract(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + ODD
    rows += [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(1000, 1300)]
    spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect(), key=repr)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        want = expected(doc_id, text)
        assert want is None or want in found[doc_id]
        planted += bool(want and want[0] and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0)
    assert planted > 10
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
