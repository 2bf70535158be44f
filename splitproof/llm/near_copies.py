"""The pipeline's near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from operator 3's multi-index over the sets' 64-bit SimHashes, which gives those that differ in 3 bits or fewer. At
0.8 two SimHashes differ in about 10 bits, beyond what segments with balls of radius 1 reach, so an index of the sets' prefixes gives
the rest. In any order of all shingles, two sets that are 0.8 alike share one of the first
n - ceil(0.8 n) + 1 of each, so that no pair is missed, and candidates are verified on the whole sets. The order is by hash, with
the shingles that are frequent in a sample last, so that few documents meet at a common passage.

Where documents meet, pairs that can't be alike go: by their sizes; by the places of the shingle they share in the order, as no more
than what stands behind both can follow if it is the first they share; in sets of up to SMALL shingles by bitmaps of 128 bits, as
each bit in which they differ is a shingle that one lacks; and in larger ones by SimHashes of 128 bits that differ in more than WIDE.
Only the last may lose a pair: at 0.8 about 20 bits differ, with a standard deviation of 4; unlike texts differ in 64. The pairs
that are left to the last round also have parities of up to WIDEST bits, in which no more bits differ than shingles do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, pick, written
from .components import components
from .simhash import _BITS, _COLUMN, links

WIDTH, WIDE, SMALL, WIDEST = 5, 44, 64, 4_096
#: The shingles that OFTEN or more documents of a sample of about SAMPLE share, FREQUENT of them at most, come last in the order.
SAMPLE, OFTEN, FREQUENT = 5_000, 4, 100_000
_TABLE = "token long, node long, n long, p long, a long, b long"
#: Candidates that a set keeps in the first round, the nearest ones; the second round takes all that are left.
KEPT = 6
#: Rows of a token among which the nearest are sought at once.
CROWD = 2_048


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles of WIDTH words (ASCII lower case): sorted XXH64 with seed 42. A shorter text is one; no words: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    starts, ends = start[: max(1, len(words) - WIDTH + 1)].tolist(), (start + size)[min(WIDTH, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _node(x: np.ndarray) -> int:
    """The name (signed 64-bit) of a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(x.tobytes(), 42) - (1 << 63) if len(x) else 0


def _sketch(x: np.ndarray) -> np.ndarray:
    """128 bits as two longs: a bitmap of up to SMALL shingles, a SimHash of more."""
    if len(x) <= SMALL:
        bits = np.zeros(128, bool)
        bits[((x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(57)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").view("<i8")
    y = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return np.array([_simhash(h) for h in (x, y ^ (y >> np.uint64(29)))], np.int64)


def _simhash(h: np.ndarray) -> int:
    """The SimHash (signed 64-bit) of some hashes; 0 of none."""
    ones = np.bincount((h.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(h)).ravel(), bitorder="little").view("<i8")[0])


def _parity(x: np.ndarray) -> bytes:
    """For each of 256 to WIDEST cells, about two a shingle, whether the number of shingles in it is odd. Of halves laid on each other it is that of half the cells."""
    cells = min(WIDEST, max(256, 1 << (2 * len(x)).bit_length()))
    at = ((x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(40)).astype(np.int64) & (cells - 1)
    return np.packbits(np.bincount(at, minlength=cells) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Cells in which two parities differ: no more than shingles that one of the sets lacks."""
    if len(x) < len(y):
        x, y = y, x
    a, n = int.from_bytes(x, "little"), 8 * len(x)
    while n > 8 * len(y):
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _prefix(x: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two sets that are 0.8 alike share one."""
    n = len(x)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        x = x[np.lexsort((x, np.where(frequent[at] == x, counts[at], 0)))]
    return x[: n - -(-4 * n // 5) + 1]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are frequent in a sample, sorted, and their counts. They order the shingles; which they are decides speed, not pairs."""
    total = docs.count()
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    some = pick(docs, doc_id="doc_id", text="text").where(F.pmod(F.xxhash64(F.lit("near"), "doc_id"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / total) * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].to_pylist():
                yield pa.record_batch({"token": shingles(text).view(np.int64)})

    counts = some.select("text").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    rows = sorted((r[0] & (2**64 - 1), r[1]) for r in counts.orderBy(F.desc("count"), "token").limit(FREQUENT).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by token, cut so that no token is in two of them, without the tokens of one row."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows and rest.num_rows else batch if batch.num_rows else rest
        if rest.num_rows:
            token = rest["token"].to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            yield _shared(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None:
        yield _shared(rest)


def _shared(rows: pa.RecordBatch) -> pa.RecordBatch:
    token = rows["token"].to_numpy()
    same = token[1:] == token[:-1]
    return rows.filter(pa.array(np.r_[same, False] | np.r_[False, same] if len(token) else np.empty(0, bool)))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node each (token, node) once, without the tokens that have one node. One row is held, however many share a token."""
    held, last, several = None, (None, None), None  # a token's only row so far, the last row, the last token if it has given rows
    for batch in batches:
        if not batch.num_rows:
            continue
        token, node = batch["token"].to_numpy(), batch["node"].to_numpy()
        new = np.r_[(token[0], node[0]) != last, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        last, rows = (token[-1], node[-1]), batch.filter(pa.array(new))
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        if rows.num_rows:
            token = rows["token"].to_numpy()
            same = token[1:] == token[:-1]
            keep = np.r_[same, False] | np.r_[False, same] | ((token == several) if several is not None else False)
            held, several = (None, token[-1]) if keep[-1] else (rows.slice(rows.num_rows - 1), None)
            yield rows.filter(pa.array(keep))


def _near(n: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the rows i and j may be alike, and the bits in which their sketches differ."""
    size, low = n[i] + n[j], np.minimum(n[i], n[j])
    bits = np.bitwise_count(a[i] ^ a[j]).astype(np.int64) + np.bitwise_count(b[i] ^ b[j])
    behind = np.minimum(n[i] - p[i], n[j] - p[j])  # the shared shingle itself and what follows it
    small = size - low <= SMALL
    return (9 * low >= 4 * size) & (9 * behind >= 4 * size) & np.where(small, 9 * bits <= size, (bits <= WIDE) | (low <= SMALL)), bits


def _pairs(every: bool):
    """Candidate pairs among the rows of each token: for each row those nearest to it that may be alike, from both sides, with the bits
    in which they differ (node, other, bits), or (every) all that lie in two components and whose parities allow it (u, v).

    Among over CROWD rows of a token the nearest are sought within CROWD rows at a time, and links that span the whole are added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _buckets(batches):
            token, node, n, p = (batch[c].to_numpy() for c in ("token", "node", "n", "p"))
            sets = (n, p, *(batch[c].to_numpy().view(np.uint64) for c in ("a", "b")))
            root = batch["root"].to_numpy() if every else None
            edges = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)
            us, vs, ds = [], [], []

            def take(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> None:
                us.append(i)
                vs.append(j)
                ds.append(bits)

            sizes = np.diff(edges)
            for g in range(2, 9):  # most tokens have few rows: all those of one number of rows at once
                starts = edges[:-1][sizes == g]
                for x, y in combinations(range(g), 2):
                    i, j = starts + x, starts + y
                    may, bits = _near(*sets, i, j)
                    if every:
                        may &= root[i] != root[j]
                    take(i[may], j[may], bits[may])
            many = np.flatnonzero(sizes > 8)
            for start, end in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
                if every:
                    for i in range(start, end - 1):
                        others = np.arange(i + 1, end)
                        others = others[root[others] != root[i]]
                        may, bits = _near(*sets, i, others)
                        take(np.full(may.sum(), i), others[may], bits[may])
                    continue
                for chunk in range(start, end, CROWD):
                    others = np.arange(chunk, min(end, chunk + CROWD))
                    for i in others.tolist():
                        may, bits = _near(*sets, i, others)
                        may[i - chunk] = False
                        hits, bits = others[may], bits[may]
                        best = np.lexsort((node[hits], bits))[:KEPT] if len(hits) > KEPT else slice(None)
                        take(np.full(len(hits[best]), i), hits[best], bits[best])
                left = np.arange(start, end) if end - start > CROWD else np.arange(0)
                while len(left) > 1:
                    front, left = [int(left[0])], left[1:]
                    while front and len(left):
                        i = front.pop()
                        may, bits = _near(*sets, i, left)
                        take(np.full(may.sum(), i), left[may], bits[may])
                        front.extend(left[may].tolist())
                        left = left[~may]
            if us:
                i, j, d = np.concatenate(us), np.concatenate(vs), np.concatenate(ds)
                u, v = node[i], node[j]
                if every:
                    pairs, first = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0, return_index=True)
                    i, j = i[first], j[first]
                    x, y = (batch["parity"].take(pa.array(k)).to_pylist() for k in (i, j))
                    pairs = pairs[9 * np.fromiter(map(_apart, x, y), np.int64, len(x)) <= n[i] + n[j]]
                    yield pa.record_batch({"u": pairs[:, 0], "v": pairs[:, 1]})
                else:
                    yield _nearest(*np.unique(np.stack([np.r_[u, v], np.r_[d, d], np.r_[v, u]], 1), axis=0).T)

    return run


def _nearest(node: np.ndarray, bits: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Of rows sorted by node, bits and other the first KEPT of each node."""
    keep = np.ones(len(node), bool)
    keep[KEPT:] = node[KEPT:] != node[:-KEPT]
    return pa.record_batch({"node": node[keep], "bits": bits[keep], "other": other[keep]})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (node, bits, other) in this order, each once, to the pairs (u, v) that are among the first KEPT of a node."""
    rest = np.empty((3, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch[c].to_numpy() for c in ("node", "bits", "other")])], 1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]]
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        rest = rows[:, cut : cut + KEPT]
        first = _nearest(*rows[:, :cut])
        yield _ends(first["node"].to_numpy(), first["other"].to_numpy())
    yield _ends(rest[0], rest[2])


def _ends(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"u": np.minimum(x, y), "v": np.maximum(x, y)})


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by token, those of a token in the order of their nodes."""
    return rows.repartition("token").sortWithinPartitions("token", "node")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are 0.8 alike. Only the texts that a pair names are read as sets again."""
    pairs = written(pairs.distinct(), "pairs")
    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ids = named.join(nodes, "node").select(F.col("least").alias("__id"))
    rows = pick(docs, doc_id="doc_id", text="text")
    rows = rows.join(ids.distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"node": pa.array(map(_node, found), pa.int64()), "hashes": pa.array((x.tobytes() for x in found), pa.binary())})

    whole = rows.select("text").mapInArrow(sets, "node long, hashes binary").join(named, "node", "left_semi").dropDuplicates(["node"])
    left, right = (whole.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "uv")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch["u_set"].to_pylist(), batch["v_set"].to_pylist(), strict=True)
            same = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sides], pa.bool_())
            yield batch.select(["u", "v"]).filter(same)

    return written(pairs.join(left, "u").join(right, "v").select("u", "v", "u_set", "v_set").mapInArrow(check, "u long, v long"), "alike")


def _indexed(sets: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of operator 3's multi-index: what connects the sets whose SimHashes are equal, and those 3 bits or fewer apart."""
    points = written(sets.groupBy("fp").agg(F.min("node").alias("first")), "points")
    equal = sets.select("fp", "node").distinct().join(points, "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    ends = (points.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "uv")
    near = links(points.select("fp")).join(next(ends), "u").join(next(ends), "v")
    return equal.unionByName(near.select(F.least("u_first", "v_first").alias("u"), F.greatest("u_first", "v_first").alias("v")))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component_id) for every row of (doc_id, text): component_id is the least doc_id that pairs 0.8 alike or more reach.

    Equal sets are one node; texts without words are one too. Pairs are sought in two rounds: first those of the multi-index and each
    set's KEPT nearest among those it meets at a shingle, so that they grow with the sets however dense a group;
    then, at each shingle, all pairs that verified links have not connected. Nulls and repeated rows are treated as in ``simhash.near_groups``.
    """
    slim = pick(docs, doc_id="doc_id", text="text")
    kind = dict(slim.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "node": pa.array(map(_node, found), pa.int64()), "fp": pa.array(map(_simhash, found), pa.int64()), "parity": pa.array(map(_parity, found), pa.binary())})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for x in map(shingles, batch["text"].to_pylist()):
                if len(x):
                    first = _prefix(x, *sent.value).view(np.int64)
                    parts.append(np.column_stack([first, np.arange(len(first)), np.broadcast_to(np.r_[_node(x), len(x), _sketch(x)], (len(first), 4))]))
            rows = np.concatenate(parts) if parts else np.empty((0, 6), np.int64)
            yield pa.record_batch({c: np.ascontiguousarray(rows[:, k]) for c, k in (("token", 0), ("node", 2), ("n", 3), ("p", 1), ("a", 4), ("b", 5))})

    rows = written(slim.mapInArrow(name, f"doc_id {kind}, node long, fp long, parity binary"), "sets")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    meetings = written(_dealt(slim.select("text").mapInArrow(index, _TABLE)).mapInArrow(_met, _TABLE), "meetings")
    spanning = _dealt(meetings).mapInArrow(_pairs(False), "node long, bits long, other long")
    kept = spanning.repartition("node").sortWithinPartitions("node", "bits", "other").mapInArrow(_kept, "u long, v long")
    found = _verified(kept.unionByName(_indexed(rows)), nodes, docs)
    roots = written(components(found), "roots")
    rooted = meetings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a token whose sets are connected already has no pair to give; tokens are judged on partial sums, so that large groups of copies go here
    mixed = rooted.groupBy("token").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("token")
    rooted = written(rooted.join(mixed, "token", "left_semi"), "rooted")
    parities = rows.join(rooted.select("node").distinct(), "node", "left_semi").select("node", "parity").dropDuplicates(["node"])
    found = found.unionByName(_verified(_dealt(rooted.join(parities, "node")).mapInArrow(_pairs(True), "u long, v long"), nodes, docs))
    roots = written(components(found), "roots")
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(joined.join(least, "root").select("node", "component_id"), "named")
    return rows.join(named, "node").select("doc_id", "node", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stay when one document of each group does, by the rules of ``simhash.drop_near_copies``."""
    groups = near_copy_groups(docs)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    rows = numbered(docs)
    return rows.join(stay, rows[f"__c{docs.columns.index('doc_id')}"].eqNullSafe(stay["__stay"]), "left_semi").toDF(*docs.columns)
