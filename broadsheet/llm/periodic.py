"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q and at least `least_exponent` periods
(4 or more) and `least_length` words that no neighbouring word extends. Words are appended
to a suffix automaton one by one. Its suffix links form a tree; for every node the last
place where its strings ended is kept by colouring: appending the word at place i colours
the whole path from the new state to the root with i. The tree is held as a link-cut
forest, in which each preferred path has one colour, so an access meets the path as few
segments. A segment that was coloured p and whose deepest node stands for l words says that
the l words ending at p and at i agree; where the distance i - p is at most l, they form a
square. A square is extended to its run by comparing words at that distance; the next
squares of a known run are skipped. A multiple of the smallest period is never met: the
nearer place agrees on more words and covers the farther one.

The automaton reads stretches that can hold a run; the rest of a text cannot, by the
distance of its words to where they stood before. In a run with period q every word after
the first q stood q places before, which holds for 3q words at least: for periods 1 to 3
that is compared directly. For longer ones, every four words but the last three after the
first q stood within q places before, and so within 2^(j+1) for 2^j <= q < 2^(j+1); runs of
3 * 2^j - 3 such places, with 2^(j+1) places before and 3 after, are read.

Words are compared by 64-bit hashes. Null and empty text: no words, no run, empty text.
A text of one word repeated is one run. Repeated rows are documents of their own, null ids
stay. Empty tables give an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import blocks, class_table, gather, mix, rolling
from broadsheet.llm.common import ship_package

_WORDS = class_table(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
_DIRECT = 3  #: periods compared directly
_GRAM = 4

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Automaton:
    """A suffix automaton whose link tree is a link-cut forest; node 0 is the root, -1 none."""

    def __init__(self) -> None:
        self.link, self.length = array("i", [-1]), array("i", [0])
        #: the transition entered first, and a table of the others where there are any
        self.word, self.to = array("q", [-1]), array("i", [-1])
        self.others: dict[int, dict[int, int]] = {}
        #: splay trees of preferred paths, shallow nodes left; a tree's root holds its colour
        self.up, self.left, self.right, self.colour = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.state = 0

    def _node(self, length: int, link: int) -> int:
        new = len(self.length)
        for column, value in ((self.link, link), (self.length, length), (self.word, -1), (self.to, -1),
                              (self.up, link), (self.left, -1), (self.right, -1), (self.colour, -1)):
            column.append(value)
        return new

    def _next(self, node: int, word: int) -> int:
        if self.word[node] == word:
            return self.to[node]
        return self.others[node].get(word, -1) if node in self.others else -1

    def _enter(self, node: int, word: int, to: int) -> None:
        if self.word[node] in (-1, word):
            self.word[node], self.to[node] = word, to
        else:
            self.others.setdefault(node, {})[word] = to

    def _splay(self, x: int) -> None:
        """Make a node the root of its tree; the root's path parent and colour move with it."""
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            for node in ((p if (left[g] == p) == (left[p] == x) else x), x) if inner else (x,):
                q = up[node]
                t = up[q]
                if left[q] == node:
                    moved = left[q] = right[node]
                    right[node] = q
                else:
                    moved = right[q] = left[node]
                    left[node] = q
                if moved >= 0:
                    up[moved] = q
                up[q], up[node] = node, t
                if t >= 0 and left[t] == q:
                    left[t] = node
                elif t >= 0 and right[t] == q:
                    right[t] = node
                else:
                    self.colour[node] = self.colour[q]

    def _clone(self, node: int, length: int) -> int:
        """A node between `node` and its link; it ends where `node` ends and so joins its preferred path."""
        new = self._node(length, self.link[node])
        self.word[new], self.to[new] = self.word[node], self.to[node]
        if node in self.others:
            self.others[new] = dict(self.others[node])
        self.link[node] = new
        self._splay(node)
        above = self.left[node]
        self.left[new], self.up[new], self.left[node] = above, node, new
        if above >= 0:
            self.up[above] = new
        return new

    def append(self, word: int, place: int) -> list[tuple[int, int]]:
        """(p, l) of each segment met: the last l words up to here last ended at p."""
        at = self.state
        self.state = new = self._node(self.length[at] + 1, 0)
        while at >= 0 and (to := self._next(at, word)) < 0:
            self._enter(at, word, new)
            at = self.link[at]
        if at >= 0:
            if self.length[to] > self.length[at] + 1:
                whole, to = to, self._clone(to, self.length[at] + 1)
                while at >= 0 and self._next(at, word) == whole:
                    self._enter(at, word, to)
                    at = self.link[at]
            self.link[new] = self.up[new] = to
        return self._access(new, place)

    def _access(self, node: int, place: int) -> list[tuple[int, int]]:
        met, below, x = [], -1, node
        while x >= 0:
            self._splay(x)
            colour = self.colour[x]
            if colour >= 0:
                met.append((colour, self.length[x]))
            if self.right[x] >= 0:  # the deeper rest of that path keeps its colour
                self.colour[self.right[x]] = colour
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = place
        return met


def _stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of runs of at least so many true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    first, last = edges[::2], edges[1::2] - 1
    long = last - first + 1 >= least
    return first[long], last[long]


def candidate_stretches(words: np.ndarray, bounds: np.ndarray, least_length: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of disjoint stretches inside documents that hold all runs of 4 periods; see the head of the module."""
    n, of = len(words), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    firsts, lasts = [], []
    for q in range(1, min(_DIRECT, n - 1) + 1):
        same = np.zeros(n, bool)
        same[q:] = (words[q:] == words[:-q]) & (of[q:] == of[:-q])
        first, last = _stretches(same, max(3 * q, least_length - q))
        firsts.append(first - q)
        lasts.append(last)
    if n >= _GRAM:
        grams = rolling(words, _GRAM)
        grams = mix(grams ^ mix(of[: len(grams)].astype(np.uint64)))
        order = np.argsort(grams, kind="stable")
        back = np.full(n, np.iinfo(np.int64).max)
        again = grams[order[1:]] == grams[order[:-1]]
        back[order[1:][again]] = (order[1:] - order[:-1])[again]
        back[: len(grams)][of[: len(grams)] != of[_GRAM - 1 :]] = np.iinfo(np.int64).max
        scale = _DIRECT + 1
        while 4 * scale <= int(np.diff(bounds).max(initial=0)):
            first, last = _stretches(back < 2 * scale, 3 * scale - _GRAM + 1)
            firsts.append(np.maximum(first - 2 * scale, bounds[of[first]]))
            lasts.append(last + _GRAM - 1)
            scale *= 2
    first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, lasts))
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    opens = np.ones(len(first), bool)
    opens[1:] = first[1:] > last[:-1]
    return first[opens], np.append(last[:-1][opens[1:]], last[-1:])


def _agree(words: np.ndarray, at: int, distance: int, step: int, end: int) -> int:
    """How many places from `at` on, in steps of +1 or -1 up to `end`, equal the place `distance` before."""
    n, width = 0, 16
    while at + step * n != end + step:
        width = min(width * 2, abs(end - at - step * n) + 1)
        low, high = (at + n, at + n + width) if step > 0 else (at - n - width + 1, at - n + 1)
        differs = np.flatnonzero(words[low:high] != words[low - distance : high - distance])
        if len(differs):
            return n + int(differs[0] if step > 0 else high - low - 1 - differs[-1])
        n += width
    return n


def runs_in(words: np.ndarray, first: int, last: int, low: int, high: int, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in words[low:high] that the automaton finds from `first` to `last`."""
    _, numbers = np.unique(words[first : last + 1], return_inverse=True)
    automaton, known, found = Automaton(), {}, []
    for i, word in enumerate(numbers.tolist()):
        for place, length in automaton.append(word, i):
            period = i - place
            if period > length or known.get(period, -1) >= i:
                continue
            end = first + i + _agree(words, first + i + 1, period, 1, high - 1)
            start = first + place - length + 1
            start -= _agree(words, start - 1 + period, period, -1, low + period)
            known[period] = end - first
            if end - start + 1 >= max(least_length, least_exponent * period):
                found.append((start, end - start + 1, period))
    return found


def block_runs(words: np.ndarray, bounds: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, by start and period; starts count from its first word."""
    if least_exponent < 4:
        raise ValueError("runs of at least four periods are found")
    found = [[] for _ in range(len(bounds) - 1)]
    for first, last in zip(*(x.tolist() for x in candidate_stretches(words, bounds, least_length))):
        doc = int(np.searchsorted(bounds, first, side="right")) - 1
        low, high = int(bounds[doc]), int(bounds[doc + 1])
        found[doc] += [(s - low, n, q) for s, n, q in runs_in(words, first, last, low, high, least_length, least_exponent)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> list[str]:
    """The kept words of each document, joined by one space."""
    starts, lengths = starts[kept], (ends - starts)[kept]
    after = np.cumsum(lengths + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    out[gather(after - lengths - 1, lengths)] = data[gather(starts, lengths)]
    upto = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(kept)])[bounds]].tolist()
    return [out[i : max(j - 1, i)].tobytes().decode() for i, j in zip(upto[:-1], upto[1:])]


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs, and the text without the words that a run holds after its first period."""
    ship_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), _WORDS):
                runs = block_runs(b.hashes(), b.doc_words, least_length, least_exponent)
                change = np.zeros(len(b.starts) + 1, np.int64)
                for first, found in zip(b.doc_words.tolist(), runs):
                    for start, length, period in found:
                        change[first + start + period] += 1
                        change[first + start + length] -= 1
                kept = np.cumsum(change[:-1]) == 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[b.first : b.first + b.docs], "n_words": pa.array(np.diff(b.doc_words)),
                    "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs],
                                     pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                    "collapsed": pa.array(collapsed(b.data, b.starts, b.ends, b.doc_words, kept), pa.string())})
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def longest_exponent(runs: Column) -> Column:
    """The run with most periods; of equals the first, then the shorter period. Exact for lengths below 2^31."""
    better = lambda a, b: ((b["length"] * a["period"] > a["length"] * b["period"])
                           | ((b["length"] * a["period"] == a["length"] * b["period"])
                              & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
