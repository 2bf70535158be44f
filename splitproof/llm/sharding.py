"""Operator 1, sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u a uniform hash of the row's key
and the child's path, and the least draw wins: a child gets rows in proportion to its weight, and a change of a weight moves
rows only into or out of the subtree that holds it. Shards added later belong to later generations. A region holds one ticket
for each generation, which weighs what that generation brought; a ticket that wins leads on only to racks and shards of its
own generation. So a new shard takes rows only into itself, at whichever rack it stands, and other rows stay where they are.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick

#: Groups within a shard that number their rows side by side. A row's group comes from its hash, so groups stay even.
SLOT_GROUPS = 4096


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    generation: int = 0


def topology(shards: int = 16, regions: int = 2, racks: int = 2, founders: int = 16) -> list[Shard]:
    """The first ``founders`` shards fill the racks in turn; each later one is a generation of its own."""
    return [Shard(s, s % regions, s // regions % racks, 1.0, max(0, s - founders + 1)) for s in range(shards)]


def _hash52(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def _winner(key: Column, node: Column, children: dict[str, dict[str, float]]) -> Column:
    """The child of ``node`` whose draw is least; ``children``: node -> child -> weight. A child's name tells its whole path."""
    table = F.create_map(*[x for n, c in sorted(children.items()) for x in (F.lit(n), F.array(*[F.struct(F.lit(k).alias("child"), F.lit(float(w)).alias("weight")) for k, w in sorted(c.items())]))])
    drawn = F.transform(table[node], lambda c: F.struct((-F.log((_hash52(key, c["child"]) + F.lit(0.5)) / F.lit(2.0**52)) / c["weight"]).alias("draw"), c["child"].alias("child")))
    return F.array_min(drawn)["child"]


def assigned(df: DataFrame, key: str, shards: list[Shard], out: str) -> DataFrame:
    """``df`` with the string column ``out``: the path generation/region/rack/shard of each row; ``key`` is a string column without nulls."""
    levels: list[dict[str, dict[str, float]]] = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for s in shards:
        if s.weight > 0:
            region, rack = f"{s.generation}/{s.region}", f"{s.generation}/{s.region}/{s.rack}"
            levels[0]["root"][region] += s.weight
            levels[1][region][rack] += s.weight
            levels[2][rack][f"{rack}/{s.shard}"] += s.weight
    df = df.withColumn(out, F.lit("root"))
    for level in levels:
        df = df.withColumn(out, _winner(F.col(key), F.col(out), level))
    return df


def shard_documents(docs: DataFrame, shards: list[Shard] | None = None, grown: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    Law ``key``: doc_id and the topology decide alone. ``size`` is the text's UTF-8 bytes plus 1; a null text has none, and CRC 0.
    A null doc_id is a key of its own. Rows that repeat get the same shard and slots of their own. An empty table gives no rows.
    ``slot`` numbers a shard's rows from 0 without gaps: by hash group, then doc_id, CRC and size. A group comes from all three, so that
    rows that share a doc_id, or have none, are numbered in many tasks. Only counts by shard and group (at most shards x SLOT_GROUPS
    rows) are broadcast.
    """
    shards = shards or topology()
    grown = grown or [*shards, Shard(max(s.shard for s in shards) + 1, 0, 0, 1.0, max(s.generation for s in shards) + 1)]

    text = pick(docs, doc_id="doc_id", text="text").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assigned(text.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "key", shards, "path")
    group = F.md5(F.concat_ws("|", "key", F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    placed = placed.withColumn("shard", F.split("path", "/")[3].cast("int")).withColumn("part", F.conv(F.substring(group, -3, 3), 16, 10).cast("int") % SLOT_GROUPS)
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = assigned(placed, "key", grown, "grown")
    within = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "part"])
    step = lambda i: F.split("path", "/")[i].cast("int")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), step(1).alias("region"), step(2).alias("rack"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.split("grown", "/")[3].cast("int").alias("grown_shard"))
