"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import cut, discard


#: Edges up to which the least neighbours of their nodes are broadcast; beyond, adaptive execution splits the join at large stars.
MOST_BROADCAST = 500_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star step on edges (u, v). Large: each node's larger neighbours go to the least of its neighbourhood; small: its smaller ones do.
    few: whether a table of the nodes may be broadcast, so that no task gets all edges of a large star."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(F.broadcast(least) if few else least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (u, v; any orderable type): the least node of its component.

    Each round is two grouped minima, each joined back, over edges alone; rounds grow with the logarithm of the longest path. They end when
    every edge leads to a root, which the edges' count and hashes tell.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, n = None, edges.count()
    while True:
        few = 2 * n <= MOST_BROADCAST
        last, edges = edges, cut(_star(_star(edges, True, few), False, few))
        discard(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
