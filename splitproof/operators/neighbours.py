"""Exact nearest neighbours and Hamming joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import ship

#: Bytes of query vectors that a block may hold; larger sets go in several passes over the base.
BLOCK_BYTES = 64 << 20


def _closest(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the first of the closest rows, and its exact squared distance.

    A matrix product gives distances that are off by rounding; rows that may still be closest are measured again, difference by difference.
    """
    q2, r2 = (q * q).sum(1), (rows * rows).sum(1)
    near = q2[:, None] + r2[None, :] - 2 * (q @ rows.T)
    slack = 1e-12 * q.shape[1] * (q2 + r2.max() + 1e-300)
    i, j = np.nonzero(near <= (near.min(1) + slack)[:, None])
    exact = ((q[i] - rows[j]) ** 2).sum(1)
    order = np.lexsort((j, exact, i))
    first = order[np.r_[True, i[order][1:] != i[order][:-1]]]
    return j[first], exact[first]


def nearest(base: DataFrame, queries: DataFrame, runs: int = 0) -> DataFrame:
    """For each query (id, vector) the base row (id, vector, label) at the least Euclidean distance, ties to the least id: (id, nn_id, nn_label).

    ``runs``: so many (63 at most) train and test sets are searched in one pass: both sides have a long ``runs`` whose bits name the
    sets they are in, and the result has ``run``.

    The queries go to the workers in blocks of bounded size; each batch of base rows keeps its best for each query, and the bests
    are combined before and after one small shuffle. Base rows never move and pairs are never rows.
    """
    if runs > 63:
        raise ValueError("a long names 63 runs at most")
    sets = [c.withColumn("runs", F.lit(1).cast("long")) if not runs else c for c in (base, queries)]
    base, queries = sets[0].select("id", "vector", "label", "runs"), sets[1].select("id", "vector", "runs")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-(size.n or 0) * (size.d or 0) * 8 // BLOCK_BYTES))
    spark, found = base.sparkSession, None
    ship(spark)
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        vectors = np.stack([np.asarray(v, np.float64) for v in part["vector"].to_pylist()])
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), vectors, part["runs"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors, tests = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.stack([np.asarray(v, np.float64) for v in batch["vector"].to_pylist()])
                own, label, trains = batch["id"].to_numpy(), batch["label"].to_numpy(), batch["runs"].to_numpy()
                order = np.argsort(own, kind="stable")
                rows, own, label, trains = rows[order], own[order], label[order], trains[order]
                for r in range(max(1, runs)):
                    train, test = np.flatnonzero(trains >> r & 1), np.flatnonzero(tests >> r & 1)
                    if not len(train):
                        continue
                    for s in range(0, len(test), 256):
                        some = test[s : s + 256]
                        best, d = _closest(vectors[some], rows[train])
                        yield pa.record_batch({"run": np.full(len(some), r, np.int32), "id": ids[some], "d": d, "nn_id": own[train[best]], "nn_label": label[train[best]].astype(np.int64)})

        one = base.mapInArrow(run, "run int, id long, d double, nn_id long, nn_label long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "run int, id long, d double, nn_id long, nn_label long")
    best = found.groupBy("run", "id").agg(F.min_by(F.struct("nn_id", "nn_label"), F.struct("d", "nn_id")).alias("b"))
    return best.select(*(["run"] if runs else []), "id", "b.nn_id", "b.nn_label")


@F.pandas_udf(LongType())
def perceptual_bits(pixels: pd.Series) -> pd.Series:
    """The 64-bit hash of 32 x 32 grey values (an array of 1,024, row by row): the 8 x 8 lowest coefficients of an orthonormal
    DCT-II, and of each whether it is over the median of all but the first; first coefficient in the top bit."""
    if not len(pixels):
        return pd.Series([], dtype="int64")
    k = np.arange(32)
    basis = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 32)[:, None] * np.cos(np.pi * (2 * k + 1)[None, :] * np.arange(8)[:, None] / 64)
    x = np.stack([np.asarray(p, np.float64) for p in pixels]).reshape(-1, 32, 32)
    z = (basis @ x @ basis.T).reshape(-1, 64)
    over = z > np.sort(z[:, 1:], 1)[:, 31:32]
    return pd.Series(np.packbits(over, 1).view(">i8").ravel().astype(np.int64))


def median_bits(vector: Column) -> Column:
    """A 64-bit hash of 64 coefficients, a bit set where the coefficient is over the median of all but the first; first coefficient in the top bit."""
    rest = F.array_sort(F.slice(vector, 2, 63))
    median = F.get(rest, F.lit(31))
    return F.aggregate(vector, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1) + F.when(x > median, 1).otherwise(0))


def _blocks(most: int) -> tuple[list[int], int]:
    """How 64 bits are cut: the blocks' edges, and how many of them make a key.

    Two hashes ``most`` bits apart agree in all but ``most`` of the blocks, so that keys of all choices of ``kept`` from
    ``most`` + ``kept`` blocks find them.
    """
    kept = 3 if most <= 4 else 2
    n = most + kept
    return [64 * i // n for i in range(n + 1)], kept


def hamming_pairs(points: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (a < b) of rows (id, bits) whose 64 bits differ in ``most`` places or fewer, with their distance.

    Keys are the choices of three of ``most`` + 3 blocks: 27 bits or more for distance 4, so that few unlike hashes meet at one. Hashes
    that meet are compared within their key's rows; a pair is kept at the first choice where it agrees, which makes it appear once
    without a further shuffle. Rows with equal bits should be made one beforehand, as ``distinct_bits`` does; then a key that many
    hashes share is a cluster whose pairs are the result. An equi-join finds them, whose larger side adaptive execution may split.
    """
    edges, kept = _blocks(most)
    spans = list(zip(edges, edges[1:], strict=False))
    masks = [sum(((1 << (hi - lo)) - 1) << lo for lo, hi in choice) for choice in combinations(spans, kept)]
    signed = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(m).alias("value")) for i, m in enumerate(signed)])
    dealt = points.select("id", "bits", F.explode(keys).alias("x")).select("id", "bits", "x.choice", "x.value")
    a, b = (dealt.select(F.col("id").alias(s), F.col("bits").alias(f"{s}_bits"), "choice", "value") for s in "ab")
    differ = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    first = F.array_position(F.array(*[differ.bitwiseAND(m) == 0 for m in signed]), F.lit(True)) - 1
    pairs = a.join(b, ["choice", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= most)).where(F.col("choice") == first)
    return pairs.select("a", "b", F.bit_count(differ).alias("distance"))


def distinct_bits(points: DataFrame) -> DataFrame:
    """One row for each hash, under its least id: copies share a node, so their pairs are never formed."""
    return points.groupBy("bits").agg(F.min("id").alias("id")).select("id", "bits")
