"""Operator 3, SimHash near-dedup by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Fingerprints that differ in 3 bits or fewer differ in at most one bit of one of
the segments. So each fingerprint enters the table of each segment under its exact value and probes the values of the Hamming
ball of radius 1 around it (only those with a bit cleared: of two values one bit apart, one finds the other), and whole distances
are verified among the fingerprints that meet at a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, pick, written
from .components import components

#: Fingerprints that may meet at one value of a segment before the value is divided by halves of the other segment.
CROWD = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(data: bytes, width: int = 3) -> int:
    """The SimHash (signed 64-bit) of a text in UTF-8: XXH64 with seed 42 of its shingles of ``width`` words, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    text, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(text, 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], 42) for a, b in zip(start[: 1 - width or None].tolist(), (start + size)[width - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.bincount((octets + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def forest(points: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of the graph whose nodes are ``points`` (uint64, distinct) and whose edges join those ``most`` bits apart."""
    left, ends, others = points, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front[-1]) <= most
            x = front.pop()
            if near.any():
                hits, left = left[near], left[~near]
                ends.append(np.full(len(hits), x, np.uint64))
                others.append(hits)
                front.extend(hits)
    return ends, others


def _links(most: int):
    """Streams rows (key, fp) that are sorted by key, and gives the links (u, v) found among the fingerprints of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(keys: np.ndarray, points: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            crowded = np.flatnonzero(np.diff(edges) > 1)
            ends, others = [], []
            for a, b in zip(edges[crowded].tolist(), edges[crowded + 1].tolist(), strict=True):
                e, o = forest(np.unique(points[a:b]), most)
                ends += e
                others += o
            if ends:
                u, v = np.concatenate(ends).view(np.int64), np.concatenate(others).view(np.int64)
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
                yield pa.record_batch({"u": pairs[:, 0], "v": pairs[:, 1]})

        for batch in batches:
            keys = np.concatenate([rest_k, batch["key"].to_numpy()])
            points = np.concatenate([rest_f, batch["fp"].to_numpy().view(np.uint64)])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from found(keys[:cut], points[:cut])
                rest_k, rest_f = keys[cut:], points[cut:]
        if len(rest_k):
            yield from found(rest_k, rest_f)

    return run


def links(points: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (u, v) that connect what fingerprints (``fp``: distinct longs) ``most`` (3 or fewer) bits apart connect.

    At every value a spanning forest is given instead of all pairs, so the pairs grow with the fingerprints, however dense a group.
    At a value where more than CROWD fingerprints meet, they meet again by halves of the other segment; what is left free then is
    16 bits, which bounds a group.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")

    def balls(value: str, bits: int, tag: str) -> str:
        """Array of keys: the value itself and each with one bit cleared, below a tag."""
        cleared = f"transform(filter(sequence(0, {bits - 1}), i -> ({value} & shiftleft(1L, i)) != 0), i -> {value} ^ shiftleft(1L, i))"
        return f"transform(concat(array({value}), {cleared}), x -> {tag} | x)"

    high, low = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"
    rows = points.select("fp", F.explode(F.expr(f"concat({balls(high, 32, '0L')}, {balls(low, 32, '4294967296L')})")).alias("key"))
    crowds = written(rows.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowds")
    if not crowds.isEmpty():
        crowd = rows.join(crowds, "key", "left_semi")
        free = f"(CASE WHEN key < 4294967296L THEN {low} ELSE {high} END)"
        halves = [balls(f"({part})", 16, tag) for part, tag in ((f"{free} & 65535L", "0L"), (f"shiftright({free}, 16)", "65536L"))]
        finer = crowd.select("fp", "key", F.explode(F.expr(f"concat({', '.join(halves)})")).alias("half")).select(F.xxhash64("key", "half").alias("key"), "fp")
        rows = rows.join(crowds, "key", "left_anti").select("key", "fp").unionByName(finer)
    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(most), "u long, v long")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text); null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) if t else 0 for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(found, pa.int64())})

    slim = pick(docs, doc_id="doc_id", text="text")
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fp long")


def near_groups(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of (doc_id, text): component_id is the least doc_id that links reach.

    Documents without words have fingerprint 0 and link like any others. Rows that repeat have the same fingerprint and component.
    A null doc_id takes part, but names a component only where no other is in it (then it is null). An empty table gives no rows.
    Equal fingerprints are one node, so copies cost nothing beyond the hash; the graph is of distinct fingerprints.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = written(components(links(nodes.select("fp"), most)), "roots")
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = joined.join(least, "root").select("fp", "component_id")
    alone = nodes.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = written(grouped.unionByName(alone), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stay when one document of each near-duplicate group does: the least doc_id.

    Rows without a doc_id can't be told apart from their group's least and stay only where the group has no doc_id at all.
    Rows that repeat the doc_id that stays all stay.
    """
    groups = near_groups(docs, width, most)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    rows = numbered(docs)
    return rows.join(stay, rows[f"__c{docs.columns.index('doc_id')}"].eqNullSafe(stay["__stay"]), "left_semi").toDF(*docs.columns)
