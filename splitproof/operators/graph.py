"""Duplicate graphs: leakage groups, what they say about a split, and how far single edges matter."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import erase
from ..session import written as _table


def _written(df: DataFrame) -> DataFrame:
    return _table(df, "graph")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (src, dst: longs); a component's name is its least node.

    Each round every node takes the least name among its neighbours' and its own, and then the name of that name, so names travel
    in doubling steps. Names are aggregated before they are shuffled; each round is written, so lineage stays short.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = _written(both)
    names = _written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("name")).select(F.col("src").alias("node"), "name").unionByName(edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("name"))).groupBy("node").agg(F.min("name").alias("name")))
    before = None
    while True:
        now = names.agg(F.count(F.lit(1)), F.sum(F.col("name").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return names.select("node", F.col("name").alias("component"))
        before, old = now, names
        heard = both.join(names, both["dst"] == names["node"]).groupBy("src").agg(F.min("name").alias("heard"))
        own = names.join(heard, names["node"] == heard["src"], "left").select("node", F.least("name", "heard").alias("name"))
        jumped = own.join(names.select(F.col("node").alias("name"), F.col("name").alias("next")), "name", "left")
        names = _written(jumped.select("node", F.least("name", "next").alias("name")))
        erase(old)


def star_edges(rows: DataFrame, node: str, key: str) -> DataFrame:
    """Edges from each row to the least row of its group: as many as rows, however large the group."""
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("dst"))
    return rows.join(least, key).where(F.col(node) != F.col("dst")).select(F.col(node).alias("src"), "dst")


def leakage_groups(rows: DataFrame, node: str, keys: list[str], edges: DataFrame | None = None) -> DataFrame:
    """(node, component) over rows that share any of the keys or an edge; rows that share nothing are their own group."""
    every = edges.select("src", "dst") if edges is not None else None
    for key in keys:
        own = star_edges(rows, node, key)
        every = own if every is None else every.unionByName(own)
    named = components(every)
    return rows.select(node).join(named.withColumnRenamed("node", node), node, "left").select(node, F.coalesce("component", F.col(node)).alias("component"))


def split_observation(nodes: DataFrame) -> DataFrame:
    """From (component, split): components on both sides, and test files in them."""
    sides = nodes.groupBy("component").agg(F.bool_or(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    both = F.col("train") & (F.col("test") > 0)
    return sides.agg(F.count_if(both).alias("crossing_groups"), F.coalesce(F.sum(F.when(both, F.col("test"))), F.lit(0)).alias("exposed_files"))


def _bridges(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each inner edge of one component what is left without it, by one walk in depth: an edge is a bridge if nothing below it reaches over it."""
    a, b = rows["src"].tolist(), rows["dst"].tolist()
    weight = dict(zip(a, rows["src_weight"].tolist(), strict=True)) | dict(zip(b, rows["dst_weight"].tolist(), strict=True))
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for e, (u, v) in enumerate(zip(a, b, strict=True)):
        near[u].append((v, e))
        near[v].append((u, e))
    size, below = int(rows["size"].iloc[0]), [0] * len(a)  # of each bridge the files on its far side
    seen, low, under = {}, {}, {}
    start = a[0]
    stack = [(start, -1, iter(near[start]))]
    seen[start] = low[start] = 0
    under[start] = weight[start]
    while stack:
        node, via, rest = stack[-1]
        for other, e in rest:
            if e == via:
                continue
            if other in seen:
                low[node] = min(low[node], seen[other])
            else:
                seen[other] = low[other] = len(seen)
                under[other] = weight[other]
                stack.append((other, e, iter(near[other])))
                break
        else:
            stack.pop()
            if stack:
                above = stack[-1][0]
                low[above] = min(low[above], low[node])
                under[above] += under[node]
                if low[node] > seen[above]:
                    below[via] = under[node]
    left = [sorted(s for s in ((x, size - x) if x else (size,)) if s > 1) for x in below]
    return pd.DataFrame({"component": rows["component"], "src": a, "dst": b, "size": size, "left": left})


def edge_omissions(edges: DataFrame, named: DataFrame) -> DataFrame:
    """For each edge the sizes (two or more) of what is left of its component without it: (component, src, dst, size, left).

    Leaving an edge out changes nothing beyond its own component. An edge whose node has no other is answered from the component's size
    alone, so that stars, such as groups of copies, never meet in a task; what remains of a component, with the weight of what was
    taken off, is walked once for its bridges.
    """
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    known = ends.join(named, "node")
    side = lambda c: known.select(F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
    rows = edges.select("src", "dst").join(known.select(F.col("node").alias("src"), F.col("degree").alias("src_degree"), "component"), "src").join(side("dst"), "dst").join(sizes, "component")
    rows = _written(rows.select("component", "src", "dst", "size", "src_degree", "dst_degree"))
    leaf = (F.col("src_degree") == 1) | (F.col("dst_degree") == 1)
    rest = F.when(F.col("size") > 2, F.array(F.col("size") - 1)).otherwise(F.array().cast("array<long>"))
    out = rows.where(leaf).select("component", "src", "dst", "size", rest.alias("left"))
    taken = rows.where(leaf).select(F.when(F.col("src_degree") == 1, F.col("dst")).otherwise(F.col("src")).alias("node")).groupBy("node").agg((F.count(F.lit(1)) + 1).alias("weight"))
    inner = rows.where(~leaf)
    for c in ("src", "dst"):
        inner = inner.join(taken.select(F.col("node").alias(c), F.col("weight").alias(f"{c}_weight")), c, "left").fillna(1, [f"{c}_weight"])
    return out.unionByName(inner.groupBy("component").applyInPandas(_bridges, "component long, src long, dst long, size long, left array<long>"))
