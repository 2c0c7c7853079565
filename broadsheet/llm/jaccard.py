"""N-gram Jaccard join over a prefix tree.

A document's set holds the hashes of its distinct word n-grams (all its words as one, if
it has fewer). Documents with equal sets form a class at once. Distinct sets are ordered
globally, rarest n-gram first; how many sets hold an n-gram is counted over all of them.
Two sets with similarity t share an n-gram among the first n - ceil(t n) + 1 of each, so
sets meet in groups by such n-grams; those found in one set alone are left out, and of
n-grams with the same members one is enough.

In a group the sets are stored in a trie, frequent n-grams first, so that copies share
their paths; runs without a branch are one node. All sets of the group descend the trie
together, adding up overlaps node by node; a subtree is left when the overlap so far and
what can still be shared, given the remaining lengths, cannot reach the bound of its
shortest set. Links that join two parts of a group not yet joined are returned, never all
pairs. Groups beyond BLOCK sets are split into blocks, and every pair of blocks is a task
of its own. Components of the links give the classes.

Rows are told apart by a 64-bit hash of id and text, so every text of a repeated or null
doc_id takes part. A class is named by its least doc_id; one without any by null.

Null or empty text: an empty set, linked with nothing, its own class. Repeated rows have
equal sets. Empty tables give an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import SPACED, blocks, mix, rolling, run_starts
from broadsheet.llm.common import stored
from broadsheet.llm.components import components
from broadsheet.llm.counting import chunk_of, layout, totals, with_totals

BLOCK = 2000  #: sets of a group in one task
PROBES = 256  #: sets that descend together


def gram_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for b in blocks(texts, SPACED):
        words = b.hashes()
        starts, runs = run_starts(b.doc_words, width)
        grams = rolling(words, width)[starts] if len(starts) else np.zeros(0, np.uint64)
        ends = np.cumsum(runs)
        for low, high, first, last in zip((ends - runs).tolist(), ends.tolist(), b.doc_words[:-1].tolist(), b.doc_words[1:].tolist()):
            if high > low:
                yield np.unique(grams[low:high])
            else:
                yield rolling(words[first:last], last - first) if last > first else np.zeros(0, np.uint64)


def row_hash() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles and a 128-bit signature of the set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    for s in gram_sets(batch.column(1), width)]
            n, one, two = np.array(rows, dtype=np.uint64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64) if one.flags.c_contiguous else one.astype(np.int64)),
                 pa.array(two.astype(np.int64))], ["doc_id", "row", "n_shingles", "sig1", "sig2"])

    return docs.select("doc_id", "text", row_hash().alias("row")).mapInArrow(sign, "doc_id long, row long, n_shingles long, sig1 long, sig2 long")


def least_overlap(total, num: int, den: int):
    """Least intersection of two sets whose sizes add up to `total`: den i >= num (total - i)."""
    return -(-num * total // (num + den))


class Trie:
    """Sequences in one global order; a node is a run of items without a branch.

    Nodes are numbered so that parents come first; node 0 is the root and holds no items.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].tobytes())
        parent, level, low, high, source = [-1], [0], [0], [0], [order[0]]
        self.at = np.zeros(len(sequences), np.int64)  #: node where each sequence ends
        path: list[int] = [0]
        previous = None
        for i in order:
            s = sequences[i]
            shared = 0
            if previous is not None:
                n = min(len(s), len(previous))
                differ = np.flatnonzero(s[:n] != previous[:n])
                shared = int(differ[0]) if len(differ) else n
            while high[path[-1]] > shared:
                node = path.pop()
                if low[node] < shared:  # the branch lies inside this run: split it
                    top = len(parent)
                    parent.append(parent[node]); level.append(0); low.append(low[node]); high.append(shared); source.append(source[node])
                    parent[node], low[node] = top, shared
                    path.append(top)
            if len(s) > shared:
                parent.append(path[-1]); level.append(0); low.append(shared); high.append(len(s)); source.append(i)
                path.append(len(parent) - 1)
            self.at[i] = path[-1]
            previous = s
        self.parent = np.array(parent)
        self.low, self.high = np.array(low), np.array(high)
        nodes = range(1, len(parent))
        depth = np.zeros(len(parent), np.int64)
        for node in sorted(nodes, key=lambda x: (high[x], low[x])):
            depth[node] = depth[parent[node]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)] if len(parent) > 1 else []
        self.deepest = self.high.copy()
        self.smallest = np.full(len(parent), np.iinfo(np.int64).max)
        self.largest = np.zeros(len(parent), np.int64)
        np.minimum.at(self.smallest, self.at, sizes)
        np.maximum.at(self.largest, self.at, sizes)
        for nodes_at in reversed(self.levels):
            np.maximum.at(self.deepest, self.parent[nodes_at], self.deepest[nodes_at])
            np.minimum.at(self.smallest, self.parent[nodes_at], self.smallest[nodes_at])
            np.maximum.at(self.largest, self.parent[nodes_at], self.largest[nodes_at])
        self.items = [sequences[source[x]][low[x] : high[x]] for x in range(len(parent))]


def linked(sequences: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that span the parts of a group joined by similarity num / den or more."""
    root = list(range(len(sequences)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(sequences) == 2:
        shared = len(np.intersect1d(*sequences, assume_unique=True))
        return [(0, 1)] if shared >= least_overlap(int(sizes.sum()), num, den) else []
    trie = Trie(sequences, sizes)
    universe, ids = np.unique(np.concatenate(trie.items), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in trie.items])])
    lengths = np.array([len(s) for s in sequences])
    at = trie.at
    spanning = []
    for first in range(0, len(sequences), PROBES):
        probes = np.arange(first, min(first + PROBES, len(sequences)))
        holds = np.zeros((len(probes), len(universe)), np.uint8)
        for row, i in enumerate(probes):
            holds[row, np.searchsorted(universe, sequences[i])] = 1
        overlap = np.zeros((len(probes), len(trie.parent)), np.int32)
        alive = np.zeros(overlap.shape, bool)
        alive[:, 0] = True
        size = sizes[probes][:, None]
        for nodes in trie.levels:
            nodes = nodes[alive[:, trie.parent[nodes]].any(axis=0)]
            if not len(nodes):
                break
            runs = cuts[nodes + 1] - cuts[nodes]
            items = ids[np.repeat(cuts[nodes] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())]
            own = np.add.reduceat(holds[:, items], np.cumsum(runs) - runs, axis=1, dtype=np.int32)
            overlap[:, nodes] = overlap[:, trie.parent[nodes]] + own
            can = np.minimum(lengths[probes][:, None], overlap[:, nodes] + (trie.deepest[nodes] - trie.high[nodes]))
            alive[:, nodes] = (alive[:, trie.parent[nodes]] & (can >= least_overlap(size + trie.smallest[nodes], num, den))
                               & (den * trie.largest[nodes] >= num * size))
        ends = at[first:]
        close = alive[:, ends] & (overlap[:, ends] >= least_overlap(size + sizes[first:], num, den))
        for row, j in zip(*np.nonzero(close)):
            i, j = int(probes[row]), first + int(j)
            p, q = find(i), find(j)
            if p != q:
                root[q] = p
                spanning.append((i, j))
    return spanning


def similarity_links(docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b) between nodes, enough to join every class; `nodes` has the rows to compare."""
    plan = layout(docs, 4)
    chunked = docs.select(chunk_of(row_hash(), plan).alias("chunk"), row_hash().alias("row"), "text", F.lit(False).alias("chosen")).unionByName(
        nodes.select(chunk_of(F.col("node"), plan).alias("chunk"), F.col("node").alias("row"),
                     F.lit(None).cast("string").alias("text"), F.lit(True).alias("chosen")))

    def sets_of(chunk: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        """Chosen rows and their sets, repeated rows once."""
        marked = chunk["chosen"].to_numpy()
        ids = chunk["row"].to_numpy()
        rows = np.flatnonzero(~marked & np.isin(ids, ids[marked]))
        rows = rows[np.unique(ids[rows], return_index=True)[1]]
        return ids[rows].tolist(), list(gram_sets(chunk["text"].take(rows), width))

    def keys_of(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = sets_of(chunk)[1]
        return np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def prefixes(chunk: pa.Table, total: np.ndarray) -> pa.Table:
        found, sets = sets_of(chunk)
        keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        out = []
        for node, s in zip(found, sets):
            held = total[np.searchsorted(keys, s)]
            order = np.lexsort((s, held))
            head = order[: len(s) - -(-num * len(s) // den) + 1]
            head = head[held[head] > 1]
            if len(head):
                shared = order[held[order] > 1][::-1]
                out.append((node, len(s), s[head].view(np.int64), s[shared].astype("<u8").tobytes()))
        node, n, head, shared = zip(*out) if out else ((), (), (), ())
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()),
                         "head": pa.array(head, pa.list_(pa.int64())), "shared": pa.array(shared, pa.binary())})

    sets = stored(with_totals(chunked, totals(chunked, keys_of, plan), prefixes, "node long, n long, head array<long>, shared binary"), "sets")
    entries = sets.select("node", F.explode("head").alias("gram"))
    groups = entries.groupBy("gram").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                         F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("members > 1")
    kept = groups.groupBy("members", "x", "y").agg(F.min("gram").alias("gram"))
    parts = F.ceil(F.col("members") / BLOCK)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = (entries.join(kept.select("gram", parts.alias("parts")), "gram").withColumn("part", part)
              .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
              .select("node", "gram", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")))
    keys = ["gram", "low", "high"]
    gathered = placed.join(sets.drop("head"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes_, sizes_, shared in _groups(batches):
            sequences = [np.frombuffer(x, "<u8") for x in shared]
            pairs = linked(sequences, np.array(sizes_), num, den)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes_[i] for i, _ in pairs], pa.int64()),
                                                  pa.array([nodes_[j] for _, j in pairs], pa.int64())], ["a", "b"])

    return gathered.select(*keys, "node", "n", "shared").mapInArrow(walk, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Runs of rows with one key; a group has at most about two blocks of sets."""
    key, nodes, sizes, shared = None, [], [], []
    for batch in batches:
        for *now, node, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if len(nodes) > 1:
                    yield nodes, sizes, shared
                key, nodes, sizes, shared = now, [], [], []
            nodes.append(node); sizes.append(n); shared.append(blob)
    if len(nodes) > 1:
        yield nodes, sizes, shared


def jaccard_members(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, row (see `row_hash`), n_shingles and component (a row of the class; null of an empty set) of every document."""
    signed = stored(signatures(docs, width), "signatures")
    same = ["sig1", "sig2"]
    nodes = signed.where("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("node"))
    found = components(similarity_links(docs, nodes, width, num, den))
    named = nodes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    return signed.join(named, same, "left").select(
        "doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of the class) of every document.

    Documents are linked from similarity num / den on.
    """
    members = stored(jaccard_members(docs, width, num, den), "members")
    # Partial minima first: a class of a third of all documents is a row per task.
    names = members.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(names, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each class, all columns: that with the least doc_id, null ids last; of a repeated row one."""
    members = stored(jaccard_members(docs, width, num, den), "members").where("component IS NOT NULL")
    kept = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"))
    rows = members.groupBy("component", "row").agg(F.count("*").alias("times"))
    marked = (rows.join(kept, "component").select(F.col("row").alias("_row"), (F.col("row") != F.col("kept.row")).alias("_drop"), "times")
              .where("_drop OR times > 1").select("_row", "_drop"))
    judged = docs.select(F.struct("*").alias("_doc"), row_hash().alias("_hash")).join(marked, F.col("_hash") == F.col("_row"), "left")
    once = judged.where("NOT _drop").dropDuplicates(["_row"])
    return judged.where("_row IS NULL").unionByName(once).select("_doc.*")
