"""Words of many texts at once: byte masks and rolling hashes over Arrow buffers.

Texts arrive as Arrow string arrays. Words are runs of bytes of one class; since every
separator used here is ASCII, working on UTF-8 bytes equals working on characters. A
word's hash is a polynomial over its bytes, taken from one running sum per block, then
mixed; all of it is whole-array arithmetic. Blocks hold about BLOCK_BYTES of text (one
document at least), so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def class_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte as hashed) for all 256 bytes; `lower` folds A-Z only."""
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[65:91] += 32
    return word, folded


#: Words between ASCII white space.
SPACED = class_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Digits, letters and all non-ASCII characters.
ALNUM = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Some consecutive documents of a batch."""

    first: int  #: index of its first document in the batch
    data: np.ndarray  #: bytes, letters folded
    bounds: np.ndarray  #: byte offset of each document and the end
    starts: np.ndarray  #: byte offset of each word
    ends: np.ndarray
    doc_words: np.ndarray  #: word offset of each document and the end
    running: np.ndarray  #: running polynomial sum, with a leading zero

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hash of each byte span; of the words by default."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        _, down = powers(len(self.data) + 1)
        return mix((self.running[ends] - self.running[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_docs(self) -> np.ndarray:
        """Index within the block of each word's document."""
        return np.repeat(np.arange(self.docs), np.diff(self.doc_words))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes of text; one row at least."""
    offsets = buffers(texts)[1]
    first = 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1, first + 1)
        yield first, last
        first = last


def blocks(texts: pa.Array, table=SPACED, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split the texts into blocks and find their words. A word never spans documents."""
    if not len(texts):
        return
    word_byte, folded = table
    data, offsets = buffers(texts)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        raw = data[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        inside = word_byte[raw]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        if len(cuts):  # a text may end and the next begin inside a word
            opens[cuts] = inside[cuts]
            closes[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(opens)
        ends = np.flatnonzero(closes) + 1
        bytes_ = folded[raw]
        up, _ = powers(len(raw) + 1)
        running = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=running[1:])
        yield Block(first, bytes_, bounds, starts, ends, np.searchsorted(starts, bounds), running)
        first = last


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values; run i starts at value i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def run_starts(doc_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each run that stays inside its document, runs per document)."""
    runs = np.maximum(np.diff(doc_words) - width + 1, 0)
    ends = np.cumsum(runs)
    first = np.repeat(doc_words[:-1] - (ends - runs), runs)
    return first + np.arange(len(first)), runs


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value is not the one before it; the first is not."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of 64-bit keys in ascending order, equal keys in order of their places; the keys so).

    Leading bits and place are sorted as one number, far faster than places by their keys. Where
    different keys agree in those bits, what is then nearly in order is sorted as it is.
    """
    low = np.uint64((1 << max(len(keys) - 1, 1).bit_length()) - 1)
    unused = 64 - max(int(keys.max(initial=0)), 1).bit_length()
    order = (np.sort(keys << np.uint64(unused) & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        again = np.argsort(ordered, kind="stable")
        order, ordered = order[again], ordered[again]
    return order, ordered
