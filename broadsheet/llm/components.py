"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with links; a component is named by its least node.

    Every round maps a node to the least of itself and its neighbours and draws the links
    between the images. Each component at least halves, so rounds grow with the logarithm
    of its size. Rounds are written to the shared folder; the maps are then followed from
    the first to the last. No component is ever brought together in one task: all steps
    are partial minima and joins that Spark can split where a node has many rows.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "least")
        maps.append(least)
        left = edges.join(least.select(F.col("node").alias("a"), F.col("to").alias("p")), "a")
        drawn = left.join(least.select(F.col("node").alias("b"), F.col("to").alias("q")), "b")
        edges = stored(drawn.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        # A node that an earlier round mapped away follows its image; one missing later had no link left.
        later = found.select(F.col("node").alias("to"), F.col("to").alias("end"))
        found = earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    return found.select("node", F.col("to").alias("component"))
