"""Keyword hits for dictionaries of any size, by a gram index.

`hits_in_lowered` puts its terms into the plan, which suits some hundred of them. Here the
terms are a table, and the plan does not depend on their number.

Up to BROADCAST_TERMS terms of BROADCAST_BYTES are broadcast. Each task makes a trie of them
and follows it from all places of a batch of texts at once, a byte deeper at each step, so
that a text is read once and no row of it is shuffled.

Of a larger dictionary one run of GRAM characters of each term, the one that the fewest texts
hold, is its entry in an index; the runs of the texts meet the index in a join, and terms
found that way are looked for in the text itself. Shorter terms are entered whole. Texts are
told apart by a 64-bit hash, so equal texts are looked through once; texts that share a hash
by chance share candidates only, not hits. A text that holds a run many times sends it once.
A frequent run is split at run time by Spark's skewed joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from broadsheet.functions.text import compute_once, has_date
from broadsheet.operators.curation import KEPT, NO_DATE, NO_KEYWORD, funnel_counts
from broadsheet.storage import stored

GRAM = 5  #: characters of an entry
BROADCAST_TERMS = 500_000  #: entries of about 50 bytes
BROADCAST_BYTES = 4_000_000  #: of all terms; a trie has at most a node for each


def _runs(text: Column, length: int) -> Column:
    """The distinct runs of so many characters; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def dictionary_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Distinct lower-case terms; null and empty ones are left out."""
    return terms.select(F.lower(term).alias("term")).where("term <> ''").distinct()


def _text_runs(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """_text, run of every distinct run of the lengths."""
    return texts.select("_text", F.explode(F.flatten(F.array(*(_runs(F.col("_low"), n) for n in lengths)))).alias("run"))


def _join_small(rows: DataFrame, small: DataFrame, size: int, on: str) -> DataFrame:
    return rows.join(F.broadcast(small) if size <= BROADCAST_TERMS else small, on)


def term_index(terms: DataFrame, texts: DataFrame, lengths: list[int], n_terms: int) -> DataFrame:
    """run, term: of each term the run that the fewest texts hold, the least of equals."""
    runs = terms.select("term", F.explode(F.when(F.length("term") <= GRAM, F.array("term")).otherwise(_runs(F.col("term"), GRAM))).alias("run"))
    # Runs of whole dictionaries are some times as many as terms; texts send counts, not rows.
    known = runs.select("run").distinct()
    held = _join_small(_text_runs(texts, lengths), known, 10 * n_terms, "run").groupBy("run").agg(F.count("*").alias("held"))
    # A term with a run that no text holds is in no text: an inner join leaves it out where that run is its rarest.
    rated = runs.join(held, "run", "left").select("term", F.struct(F.coalesce("held", F.lit(0)).alias("held"), "run").alias("entry"))
    return rated.groupBy("term").agg(F.min("entry").alias("entry")).where("entry.held > 0").select("entry.run", "term")


def _trie_search(terms: Broadcast, most: int = 1 << 20) -> Callable:
    """The task that finds the sorted, distinct terms in texts, all as bytes. Workers need not import this package."""

    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        # Bytes that no term holds, and the ends of texts, are class 0, from which no path goes on.
        data = np.frombuffer(b"".join(terms.value), np.uint8)
        used, n_terms = np.unique(data), len(terms.value)
        classes, width = np.zeros(256, np.int64), len(used) + 1
        classes[used] = np.arange(1, width)
        lengths = np.array([len(t) for t in terms.value])
        starts = np.cumsum(lengths) - lengths
        # Nodes are numbered level by level, so the edges (node, class) are sorted and edge i leads to node i + 1.
        node, levels, n_nodes = np.zeros(n_terms, np.int64), [], 1
        for depth in range(lengths.max()):
            longer = np.flatnonzero(lengths > depth)
            edge, place = np.unique(node[longer] * width + classes[data[starts[longer] + depth]], return_inverse=True)
            node[longer] = n_nodes + place
            levels.append(edge)
            n_nodes += len(edge)
        edges = np.concatenate(levels)
        term_of = np.full(n_nodes, -1)
        term_of[node] = np.arange(n_terms)
        # The upper levels as a table; few paths go deeper in a dictionary that has more.
        near = np.zeros(min(n_nodes * width, 16 * most), np.int32)
        in_table = int(np.searchsorted(edges, len(near)))
        near[edges[:in_table]] = np.arange(1, in_table + 1)

        def following(edge):
            if not len(edge) or edge.max() < len(near):
                return near[edge]
            at = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
            return np.where(edges[at] == edge, at + 1, 0)

        def found(data, sizes):
            """Places text * n_terms + term of all terms in the texts."""
            n = len(sizes)
            text = np.repeat(np.arange(n), sizes + 1)
            inside = np.ones(len(text), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            codes = np.zeros(len(text), np.int64)
            codes[inside] = classes[data]
            held = np.zeros(n * n_terms, bool)
            at, node = np.flatnonzero(codes), 0
            while len(at):
                child = following(node * width + codes[at])
                on = np.flatnonzero(child)
                at, node = at[on], child[on].astype(np.int64)
                term = term_of[node]
                whole = np.flatnonzero(term >= 0)
                held[text[at[whole]] * n_terms + term[whole]] = True
                at = at + 1
            return np.flatnonzero(held)

        known = pa.array(terms.value, pa.binary()).cast(pa.string())
        for column in columns:
            column = column.cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            counts, ids, first = [np.zeros(1, np.int64)], [], 0
            while first < len(column):
                # As many texts as have `most` bytes together, one at least, and room for their terms.
                last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
                last = max(first + 1, min(last, first + 8 * most // n_terms, len(column)))
                places = found(data[bounds[first] : bounds[last]], np.diff(bounds[first : last + 1]))
                counts.append(np.bincount(places // n_terms, minlength=last - first))
                ids.append(places % n_terms)
                first = last
            offsets = pa.array(np.cumsum(np.concatenate(counts)), pa.int32())
            yield pa.ListArray.from_arrays(offsets, known.take(pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))))

    return search


def with_dictionary_hits(
    articles: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", hits: str = "hits"
) -> DataFrame:
    """Add the sorted distinct terms that occur in the text, ignoring case, as `keyword_hits` does.

    Null texts have no hits. Dictionaries too large to be broadcast get an index, which is
    written to the shared folder, as it is used with all texts; texts are read twice for it
    and once for their hits.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    known = stored(dictionary_terms(terms, term), "terms")
    sizes = known.groupBy(F.least(F.length("term"), F.lit(GRAM)).alias("n")).agg(
        F.count("*").alias("terms"), F.sum(F.octet_length("term")).alias("bytes")).collect()  # GRAM rows at most
    lengths, n_terms = sorted(r.n for r in sizes), sum(r.terms for r in sizes)
    none = F.array().cast("array<string>")
    if not lengths:
        return articles.withColumn(hits, none)
    if n_terms <= BROADCAST_TERMS and sum(r.bytes for r in sizes) <= BROADCAST_BYTES:
        shared = articles.sparkSession.sparkContext.broadcast(sorted(bytes(r.term) for r in known.select(F.col("term").cast("binary")).collect()))
        # Called nondeterministic, so that filters on the hits do not search a second time.
        search = F.arrow_udf(_trie_search(shared), "array<string>").asNondeterministic()
        return articles.withColumn(hits, search(low.cast("binary")))
    texts = articles.select(low.alias("_low")).select("_low", F.xxhash64("_low").alias("_text"))
    index = stored(term_index(known, texts, lengths, n_terms), "index")
    found = _join_small(_text_runs(texts, lengths), index, n_terms, "run").groupBy("_text").agg(F.collect_set("term").alias("_terms"))
    # Pinned, so that the text is not lowered once for every candidate.
    keyed = compute_once(articles.join(found, F.xxhash64(low) == F.col("_text"), "left"), _low=low)
    held = F.filter("_terms", lambda t: F.contains(F.col("_low"), t))
    return keyed.withColumn(hits, F.array_sort(F.coalesce(held, none))).drop("_text", "_terms", "_low")


def curate_by_dictionaries(
    articles: DataFrame, tier1: DataFrame, tier2: DataFrame, text: str = "text", observation: Observation | None = None
) -> DataFrame:
    """`curation.curate` with keyword lists that are tables (column ``term``), of any size.

    The articles kept are written to the shared folder before tier 2 is looked for in them;
    ``observation``, if given, observes the funnel meanwhile.
    """
    hits = with_dictionary_hits(articles, tier1, text, hits="tier1_keywords")
    outcome = F.when(~has_date(F.col(text)), NO_DATE).when(F.size("tier1_keywords") == 0, NO_KEYWORD).otherwise(KEPT)
    judged = compute_once(hits, outcome=outcome)
    if observation is not None:
        judged = judged.observe(observation, *funnel_counts())
    kept = stored(judged.where(F.col("outcome") == KEPT).drop("outcome"), "kept")
    return with_dictionary_hits(kept, tier2, text, hits="tier2_keywords")
