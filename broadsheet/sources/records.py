"""Records and row numbers of text files that are read by many tasks.

A CSV cell in quotes may hold line breaks, so where a block of a file begins it is not
known whether a quote is open. Every block is therefore scanned for both cases: for each
of its lines, whether a quote is open before it and how many records ended before it. The
blocks of a file, one row each, are then followed from its start, which tells each block
its case and how many records lie before it. With that known each block is read once more
and its lines are joined to records. Only records that lie in several blocks are brought
together; all others stay where they were read.

A quote opens at the start of a cell only; inside, two quotes are one. Blank lines between
records are left out. Line breaks are line feeds, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.storage import stored

MOST_LINES = 100_000  #: of one record within a block; more means that a quote was never closed
BROADCAST_BLOCKS = 200_000  #: about 20 MB of offsets

_SCAN = "file string, block long, seq long, open_0 boolean, records_0 long, longest_0 long, open_1 boolean, records_1 long, longest_1 long"
_JOINED = "row_pos long, file_pos long, block long, part boolean, record string"

# The tasks need nothing but what is in the functions that make them, so workers need not import this package.


def _quotes() -> Callable:
    """The function that tells whether a quote is open after a line, from whether one is open before it."""
    import re

    closed = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
    cells = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?,)*+')

    def open_after(line: str, is_open: bool) -> bool:
        at = 0
        if is_open:
            end = closed.match(line)
            if not end:
                return True
            at = line.find(",", end.end()) + 1
            if not at:
                return False
        at = cells.match(line, at).end()
        return line.startswith('"', at) and not closed.match(line, at + 1)

    return open_after


def _states(quoted: bool) -> Callable:
    """The function that gives of some lines of a block, for each case, whether a quote is open before and after each, and whether it ends a record."""
    open_after = _quotes()

    def states(value, cases: list):
        import numpy as np
        import pyarrow.compute as pc

        marked = np.flatnonzero(np.asarray(pc.match_substring(value, '"'))) if quoted else np.zeros(0, int)
        lines = value.take(marked).to_pylist()
        blank = np.asarray(pc.utf8_is_space(value)) | (np.asarray(pc.binary_length(value)) == 0)
        for is_open in cases:
            # Of the lines with a quote, those after which it is another case.
            now, turns = is_open, []
            for i, line in enumerate(lines):
                then = open_after(line, now)
                if then != now:
                    now = then
                    turns.append(i)
            flips = np.zeros(len(value), np.int64)
            flips[marked[turns]] = 1
            after = (np.cumsum(flips) & 1).astype(bool) ^ is_open
            before = np.append(is_open, after[:-1])
            yield before, after, ~after & ~(blank & ~before)

    return states


def _block_scanner(quoted: bool) -> Callable:
    """The task that scans blocks for both cases; a row for each batch of a block, the last of which is that of the block."""
    states = _states(quoted)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        here, seq, state, records, length, longest = None, 0, [False, True], [0, 0], [0, 0], [0, 0]
        for batch in batches:
            file, block, value = batch.columns
            starts, n = block.to_numpy(), len(value)
            other = np.asarray(pc.not_equal(file[1:], file[:-1])) | (starts[1:] != starts[:-1])
            edges = [0, *(np.flatnonzero(other) + 1).tolist(), n] if n else [0]
            for first, last in zip(edges[:-1], edges[1:]):
                at = (file[first].as_py(), int(starts[first]))
                if here != at:
                    here, seq, state, records, length, longest = at, 0, [False, quoted], [0, 0], [0, 0], [0, 0]
                k = last - first
                for case, (before, after, ends) in enumerate(states(value[first:last], list(state))):
                    shut = np.concatenate([[-1 - length[case]], np.flatnonzero(~before), [k]])
                    longest[case] = max(longest[case], int(np.diff(shut).max()) - 1)
                    length[case] = int(k - 1 - shut[-2])
                    state[case], records[case] = bool(after[-1]), records[case] + int(ends.sum())
                seq += k
                row = {"file": here[0], "block": here[1], "seq": seq}
                for c in (0, 1):
                    row |= {f"open_{c}": state[c], f"records_{c}": records[c], f"longest_{c}": longest[c]}
                yield pa.RecordBatch.from_pylist([row])

    return scan


def _record_joiner(quoted: bool, parts: bool) -> Callable:
    """The task that joins the lines of a block to records, its case being known.

    Gives the records that lie within a block, or else the parts of those that do not.
    """
    states = _states(quoted)

    def join(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def several(rows):
            """Records or parts of several lines: (row_pos, file_pos, block, part, record)."""
            rows = [r for r in rows if r[3] == parts]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        names = ["row_pos", "file_pos", "block", "part", "record"]
        here, rows = None, []
        for batch in batches:
            key, block, value, opened, earlier, first_record = batch.columns
            keys, n = key.to_numpy(), len(value)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), n] if n else [0]
            for first, last in zip(edges[:-1], edges[1:]):
                if here != keys[first]:
                    if here is not None and pending:
                        rows.append((number, file_pos, start, True, "\n".join(pending)))
                    here, start, file_pos = keys[first], block[first].as_py(), first_record[first].as_py()
                    is_open, number, pending = opened[first].as_py(), earlier[first].as_py(), []
                    headless = is_open
                k = last - first
                text = value[first:last]
                (before, after, ends), = states(text, [is_open])
                row_pos = number + np.cumsum(ends) - ends
                single = np.flatnonzero(ends & ~before)
                if len(single) and not parts:
                    same = np.full(len(single), file_pos), np.full(len(single), start), np.zeros(len(single), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(row_pos[single]), *map(pa.array, same), text.take(single)], names)
                long = np.flatnonzero(before | after)
                for i, line in zip(long.tolist(), text.take(long).to_pylist()):
                    pending.append(line)
                    if not after[i]:
                        rows.append((int(row_pos[i]), file_pos, start, headless, "\n".join(pending)))
                        pending, headless = [], False
                is_open, number = bool(after[-1]), number + int(ends.sum())
            if rows:
                yield several(rows)
                rows = []
        if here is not None and pending:
            yield several([(number, file_pos, start, True, "\n".join(pending))])

    return join


def _follower(most: int) -> Callable:
    """The function that follows the blocks of one file, one row each."""

    def follow(blocks):
        import pyarrow as pa

        is_open, before, out, crosses = False, 0, [], []
        for row in blocks.sort_by("block").to_pylist():
            out.append((row["file"], row["block"], is_open, before))
            case = int(is_open)
            crosses.append(is_open or row[f"open_{case}"])
            if row[f"longest_{case}"] > most:
                raise ValueError(f"a record of more than {most} lines: a quote is never closed in {row['file']}")
            is_open, before = row[f"open_{case}"], before + row[f"records_{case}"]
        file, block, opened, records = zip(*out)
        return pa.table({"file": list(file), "block": pa.array(block, pa.int64()), "is_open": list(opened), "before": pa.array(records, pa.int64()),
                         "crosses": crosses, "in_file": pa.array([before + is_open] * len(out), pa.int64())})

    return follow


def block_offsets(scanned: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """file, block, is_open, crosses (a record lies in this block and another), before (records of all files up to there), first (number of the file's first record).

    One row per block; what is brought together is one row per file and one per block of a file.
    """
    last = [f"{c}_{case}" for c in ("open", "records", "longest") for case in (0, 1)]
    ends = scanned.groupBy("file", "block").agg(*(F.max_by(c, "seq").alias(c) for c in last))
    blocks = ends.groupBy("file").applyInArrow(_follower(most), "file string, block long, is_open boolean, before long, crosses boolean, in_file long")
    files = blocks.groupBy("file").agg(F.max("in_file").alias("in_file"))
    earlier = files.selectExpr("file", "coalesce(sum(in_file) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first")
    return blocks.join(earlier, "file").select("file", "block", "is_open", "crosses", (F.col("first") + F.col("before")).alias("before"), "first")


def records(spark: SparkSession, path: str, quoted: bool = True, most: int = MOST_LINES) -> DataFrame:
    """`record`, `row_pos`, `file_pos` and `is_header` of every record of a CSV file or folder.

    `row_pos` numbers the records of all files, in order of their paths, from 0; `file_pos`
    is the number of a file's first record, its header. With `quoted` false every line is
    a record. The blocks are scanned at once and what is known of each is written to the
    shared folder; the records are made when they are read.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    offsets = stored(block_offsets(lines.mapInArrow(_block_scanner(quoted), _SCAN), most), "blocks")
    few = offsets.count() <= BROADCAST_BLOCKS

    def placed(blocks: DataFrame) -> DataFrame:
        """The lines of the blocks in their order, with what is known of the block."""
        blocks = blocks.select("*", F.xxhash64("file", "block").alias("key"))
        keep = ["key", "block", "value", "is_open", "before", "first"]
        if few:
            return lines.join(F.broadcast(blocks), ["file", "block"]).select(*keep)
        # Shuffled to meet their blocks, and put in order again.
        numbered = lines.withColumn("seq", F.monotonically_increasing_id()).join(blocks, ["file", "block"])
        return numbered.repartition("file", "block").sortWithinPartitions("file", "block", "seq").select(*keep)

    whole = placed(offsets).mapInArrow(_record_joiner(quoted, False), _JOINED).select("row_pos", "file_pos", "record")
    # Few blocks have such records; only their lines are scanned again.
    parts = placed(offsets.where("crosses")).mapInArrow(_record_joiner(quoted, True), _JOINED).groupBy("row_pos").agg(
        F.min("file_pos").alias("file_pos"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("lines"))
    joined = parts.select("row_pos", "file_pos", F.array_join(F.transform("lines", lambda x: x["record"]), "\n").alias("record"))
    text = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    is_header = F.col("row_pos") == F.col("file_pos")
    plain = F.when(is_header, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return joined.unionByName(whole).select("row_pos", "file_pos", is_header.alias("is_header"), plain.alias("record"))


def split_cells(rows: DataFrame) -> DataFrame:
    """`row_pos`, `file_pos`, `is_header`, `cells`: the cells of each record, whatever their number."""

    def split(batches: Iterator) -> Iterator:
        import csv

        import pyarrow as pa

        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            found = [next(csv.reader([record])) for record in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], [*keys, "cells"])

    keys = ["row_pos", "file_pos", "is_header"]
    return rows.select(*keys, "record").mapInArrow(split, "row_pos long, file_pos long, is_header boolean, cells array<string>")


def cells(rows: DataFrame) -> DataFrame:
    """`row_pos`, `file_pos`, `is_header`, `pos`, `cell`: each cell of each record by its place."""
    return split_cells(rows).select("row_pos", "file_pos", "is_header", F.posexplode("cells").alias("pos", "cell"))
