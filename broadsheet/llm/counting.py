"""Counts of very many keys, asked for and answered in bulk.

Documents are dealt into chunks by a hash of their id. A chunk lists the distinct keys it
holds, sorted, with their counts; the list is split by leading bits into buckets, each
bucket adds up what all chunks sent and answers every chunk in the order of its list. So a
key costs one entry per chunk that has it, however often it occurs, and a frequent key is
no larger than a rare one. Chunks and buckets grow in number with the input; each is
bounded in bytes. All of it is two shuffles of narrow binary columns.

A chunk's own counts fit 32 bits, as its texts are one Arrow column of less than 2 GB. Sums
over all chunks are 64 bits: a reply carries the low halves, and the high halves of a bucket
only where one of its sums needs them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import changes, sorted_places
from broadsheet.llm.common import shuffle_partitions, text_bytes

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20


@dataclass
class Layout:
    chunks: int
    bits: int  #: of a key, that name its bucket
    width: int  #: bytes of a key that are sent; bits beyond are left to chance
    lean: bool = False  #: differences of keys, numbers in planes of bytes, compressed


def layout(docs: DataFrame, width: int, lean: bool = False) -> Layout:
    size, least = text_bytes(docs), shuffle_partitions(docs.sparkSession)
    return Layout(max(least, -(-size // CHUNK_BYTES)), max(least, -(-size // BUCKET_BYTES)).bit_length(), width, lean)


def chunk_of(spread: Column, plan: Layout) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(plan.chunks)).cast("int")


def _squeeze(numbers: np.ndarray, bytes_each: int = 4) -> bytes:
    """Planes of bytes, the least first: most planes are zeros, and shrink."""
    planes = numbers.astype("<u8").view("u1").reshape(-1, 8)[:, :bytes_each].T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _expand(blob: bytes, n: int, bytes_each: int = 4) -> np.ndarray:
    planes = np.zeros((n, 8), "u1")
    planes[:, :bytes_each] = np.frombuffer(pa.decompress(blob, bytes_each * n, codec="zstd", asbytes=True), "u1").reshape(bytes_each, n).T
    return planes.reshape(-1).view("<u8")


def _numbers(numbers: np.ndarray, lean: bool) -> bytes:
    """32-bit numbers; lean ones start with how many they are."""
    return len(numbers).to_bytes(4, "little") + _squeeze(numbers) if lean else numbers.astype("<u4").tobytes()


def _read(blob: bytes, lean: bool) -> np.ndarray:
    return _expand(blob[4:], int.from_bytes(blob[:4], "little")).astype(np.int64) if lean else np.frombuffer(blob, "<u4").astype(np.int64)


def _pack(keys: np.ndarray, plan: Layout) -> list[bytes]:
    """The bits after the bucket's, in blocks of 4 bytes and the rest."""
    rest = keys << np.uint64(plan.bits)
    if plan.lean:
        steps = np.diff(rest >> np.uint64(64 - 8 * plan.width), prepend=np.uint64(0))
        if plan.width <= 4:
            return [_squeeze(steps, plan.width)]
        return [steps.astype("<u4").tobytes(), _squeeze(steps >> np.uint64(32), plan.width - 4)]
    blobs = [(rest >> np.uint64(32)).astype("<u4").tobytes()]
    if plan.width > 4:
        blobs.append((rest >> np.uint64(16)).astype("<u2").tobytes())
    return blobs


def _unpack(blob: bytes, n: int, plan: Layout) -> np.ndarray:
    if plan.lean and plan.width <= 4:
        return np.cumsum(_expand(blob, n, plan.width), dtype=np.uint64)
    keys = np.frombuffer(blob, "<u4", n).astype(np.uint64)
    if plan.lean:
        return np.cumsum(keys | _expand(blob[4 * n :], n, plan.width - 4) << np.uint64(32), dtype=np.uint64)
    if plan.width > 4:
        keys = keys << np.uint64(16) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64)
    return keys


def totals(chunked: DataFrame, keys_of: Callable, plan: Layout, earlier: DataFrame | None = None) -> DataFrame:
    """(chunk, bucket, totals, high): for each chunk and bucket the sums over all chunks, in halves of 32 bits.

    `keys_of` gives the sorted distinct 64-bit keys of a chunk and their counts; `chunked`
    has the column chunk. With `earlier` (see `phases`) it also gets the totals of each earlier phase.
    """

    def ask(chunk: pa.Table) -> pa.Table:
        return sent(chunk, *keys_of(chunk))

    def ask_next(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        return sent(chunk, *keys_of(chunk, by_phase(replies, plan)))

    def sent(chunk: pa.Table, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        cuts = np.searchsorted(keys >> np.uint64(64 - plan.bits), np.arange((1 << plan.bits) + 1))
        rows = [(b, b"".join(_pack(keys[i:j], plan)), _numbers(counts[i:j], plan.lean), j - i)
                for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
        bucket, sent, count, n = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk["chunk"][0].as_py()] * len(rows), pa.int32()),
                         "keys": pa.array(sent, pa.binary()), "counts": pa.array(count, pa.binary()), "n": pa.array(n, pa.int32())})

    def answer(asked: pa.Table) -> pa.Table:
        n = asked["n"].to_pylist()
        keys = np.concatenate([_unpack(k, m, plan) for k, m in zip(asked["keys"].to_pylist(), n)])
        counts = np.concatenate([_read(c, plan.lean) for c in asked["counts"].to_pylist()])
        order, ordered = sorted_places(keys)
        first = np.flatnonzero(changes(ordered))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(first, append=len(keys)))
        low, high = (total & 0xFFFFFFFF).astype("<u4"), (total >> 32).astype("<u4")
        spans = [(e - m, e) for e, m in zip(np.cumsum(n).tolist(), n)]
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"],
                         "totals": pa.array([_numbers(low[i:j], plan.lean) for i, j in spans], pa.binary()),
                         "high": pa.array([high[i:j].tobytes() if high[i:j].any() else b"" for i, j in spans], pa.binary())})

    grouped = chunked.groupBy("chunk") if earlier is None else chunked.groupBy("chunk").cogroup(earlier.groupBy("chunk"))
    asked = grouped.applyInArrow(ask if earlier is None else ask_next, "bucket int, chunk int, keys binary, counts binary, n int")
    return asked.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, totals binary, high binary")


def in_order(replies: pa.Table, lean: bool = False) -> np.ndarray:
    """A chunk's totals, in the order of its keys."""
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, t, h in sorted(zip(*(replies[c].to_pylist() for c in ("bucket", "totals", "high")))):
        low.append(_read(t, lean))
        high.append(np.frombuffer(h, "<u4").astype(np.int64) if h else np.zeros(len(low[-1]), np.int64))
    return np.concatenate(low) | np.concatenate(high) << 32


def phases(replies: list[DataFrame]) -> DataFrame:
    """Replies of phases that followed each other, as one table."""
    return functools.reduce(DataFrame.unionByName, [r.withColumn("phase", F.lit(i)) for i, r in enumerate(replies)])


def by_phase(replies: pa.Table, plan: Layout) -> Callable[[int], np.ndarray]:
    phase = replies["phase"].to_numpy()
    return lambda i: in_order(replies.filter(pa.array(phase == i)), plan.lean)


def with_totals(chunked: DataFrame, replies: DataFrame, use: Callable, schema: str, plan: Layout | None = None, lean: bool = False) -> DataFrame:
    """Give each chunk's rows and totals to `use`; with a plan, the totals `by_phase`. `lean` as in the layout of a single phase."""

    def both(chunk: pa.Table, asked: pa.Table) -> pa.Table:
        return use(chunk, by_phase(asked, plan) if plan else in_order(asked, lean))

    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)
