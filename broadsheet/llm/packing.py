"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's ids and an end id are cut into whole windows and one rest. The rest goes to
the fill level that keeps the sum of squared counts of partially filled windows smallest:
an array holds how many windows stand at each level, and moving a window from level h to
h + s changes the sum by -2 n[h] + 1 and + 2 n[h + s] + 1 (nothing if it gets full). When
a task's documents end, the windows still open are closed by cutting the pieces of the
emptiest to fill the fullest, so a task leaves one window short at most.

Tasks pack their own rows: no shuffle, and no key that could be hot. A task holds the ids
of open windows only. Window ids join the task's number and a counter; a task that runs
again replaces its rows as a whole.

Ids come from the given byte-level tokenizer file (see `vocabularies`); its special tokens'
strings in a text are special tokens.

Null text counts as empty: the end id alone. Repeated rows are packed each. Very long
texts span several windows. Empty tables give no rows. Extra columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from broadsheet.llm.bytewords import slices
from broadsheet.llm.vocabularies import byte_level

WINDOW = 2048
BLOCK_BYTES = 4 << 20  #: of text encoded before its full windows are returned

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

class Packer:
    """Windows of one task. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  #: the level array
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.full: list[list[tuple]] = []

    def level(self, size: int) -> int:
        """The fill level whose window takes a piece of this size; 0 opens a window."""
        room = self.window - size
        fits = np.flatnonzero(self.count[1 : room + 1]) + 1
        target = fits + size
        gain = 1 - 2 * self.count[fits] + np.where(target < self.window, 2 * self.count[target] + 1, 0)
        fresh = 2 * self.count[size] + 1
        if len(fits):
            best = len(gain) - 1 - int(np.argmin(gain[::-1]))  # of equals the fullest
            if gain[best] <= fresh:
                return int(fits[best])
        return 0

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.level(size) if size < self.window else 0
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            self.full.append(pieces)
        else:
            self.open[level + size].append(pieces)
            self.count[level + size] += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.full.append([(doc, at, ids[at : at + self.window], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:].copy(), len(ids)))

    def close(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest, cut where they must be."""
        left = [(level, w) for level in range(1, self.window) for w in self.open[level]]
        low, high = 0, len(left) - 1
        spare: list[tuple] = []
        while low <= high:
            level, pieces = left[high]
            high -= 1
            while level < self.window and (spare or low <= high):
                if not spare:
                    spare = left[low][1]
                    low += 1
                doc, start, ids, tokens = spare.pop()
                take = min(len(ids), self.window - level)
                pieces.append((doc, start, ids[:take], tokens))
                level += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], tokens))
            self.full.append(pieces)
        while spare:  # what is left of the last one taken apart is a window of its own
            self.full.append(spare)
            spare = []

    def drain(self, base: int, done: int) -> pa.RecordBatch:
        """Rows of the finished windows."""
        rows = []
        for n, pieces in enumerate(self.full):
            offset = 0
            for doc, start, ids, tokens in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((doc, start, len(ids), crc, tokens, base + done + n, offset))
                offset += len(ids)
        self.full = []
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: its place in its document and in its sequence."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, packer = TaskContext.get().partitionId() << 40, 0, Packer(window)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            for first, last in slices(texts, BLOCK_BYTES):
                part = zip(ids[first:last].to_pylist(), byte_level(tokenizer).encode(texts[first:last].to_pylist()))
                for doc, found in part:
                    packer.add(doc, np.concatenate([found, end]))
                n = len(packer.full)
                yield packer.drain(base, done)
                done += n
        packer.close()
        yield packer.drain(base, done)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)
