"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them and itself: those above the node (large), or those below and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where(F.col("v") < F.col("u"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        hung = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = seen.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (u, v: longs); the root is the least node of its component.

    Each round writes its edges to the shared folder, and the ones before are deleted. Least neighbours are aggregated before they are shuffled, and a node with
    many neighbours meets them in a join that adaptive execution may split; no task gathers a component. Loops and repeated
    edges change nothing; no edges give no rows. It ends when a round changes nothing, after O(log^2 n) rounds.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (now := mark(edges)) != before and now[0]:
        before, old, edges = now, edges, written(_star(_star(edges, True), False), "edges")
        erase(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
