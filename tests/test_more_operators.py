"""Kernels, graphs and resampling against plain implementations."""

from __future__ import annotations

import os
import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitproof import session
from splitproof.functions import exact, risk
from splitproof.operators import graph, neighbours, resampling, series


def test_chances_of_groups_of_any_size(spark):
    cases = [(100, 30, 0), (100, 30, 1), (100, 30, 31), (100, 97, 90), (100, 100, 100), (20_000, 19_990, 15_000), (20_000, 12_000, 5_000), (1_000_000, 999_000, 300_000), (10**7, 10**7 - 6000, 5000), (10**9, 10**9 - 10**5, 10**6 // 8), (20_000, 15_000, 14_990)]
    rows = spark.createDataFrame(cases, "m long, t long, k long").select("m", "t", "k", risk.all_drawn(F.col("m"), F.col("t"), F.col("k")).alias("q")).collect()
    for r in rows:
        want = float(Fraction(comb(r.m - r.k, r.t - r.k), comb(r.m, r.t))) if r.m <= 20_000 and r.k <= r.t else 0.0 if r.k > r.t else float(np.exp(np.log1p(-np.longdouble(r.m - r.t) / (r.m - np.arange(r.k, dtype=np.longdouble))).sum()))
        assert r.q == pytest.approx(want, rel=1e-8, abs=1e-300), r


def test_exact_chances():
    for m, t, k in ((30, 8, 3), (30, 28, 20), (10, 10, 10), (10, 0, 2), (10, 3, 0)):
        assert exact.all_drawn(m, t, k) == (Fraction(comb(m - k, t - k), comb(m, t)) if k <= t else 0)


def omissions(edges):
    out = []
    for skip in range(len(edges)):
        near = {}
        for i, (a, b) in enumerate(edges):
            near.setdefault(a, set()), near.setdefault(b, set())
            if i != skip:
                near[a].add(b)
                near[b].add(a)

        def part(x):
            seen, todo = {x}, [x]
            while todo:
                fresh = near[todo.pop()] - seen
                seen |= fresh
                todo += fresh
            return frozenset(seen)

        a, b = edges[skip]
        parts = {part(a), part(b)}
        out.append((a, b, sum(map(len, parts)), sorted(len(p) for p in parts if len(p) > 1)))
    return sorted(out)


def test_edges_left_out(spark):
    rng = random.Random(1)
    edges = []
    for c in range(12):
        nodes = [100 * c + i for i in range(rng.randint(2, 9))]
        edges += [(nodes[i], nodes[rng.randrange(i)]) for i in range(1, len(nodes))]
        edges += [tuple(rng.sample(nodes, 2)) for _ in range(rng.randint(0, 3))]
    edges += [(5000 + i, 5000) for i in range(1, 40)] + [(6000, 6001), (6000, 6001)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = graph.edge_omissions(df, graph.components(df)).collect()
    assert sorted((r.src, r.dst, r.size, list(r.left)) for r in got) == omissions(edges)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 97, 1000])
def test_permutations(spark, size):
    rows = spark.range(size).select(F.col("id").alias("place"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("r"))
    out = rows.select("place", "r", resampling.permuted(F.col("place"), F.col("r"), F.lit(size).cast("long"), 7).alias("to")).collect()
    for r in (0, 1):
        assert sorted(x.to for x in out if x.r == r) == list(range(size))
    if size == 1000:
        assert sum(x.to == x.place for x in out) < 20


def test_pairs_of_near_hashes(spark):
    rng, points = random.Random(3), set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(10):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)], "id long, bits long").repartition(4)
    for most in (0, 2, 4, 6):
        got = sorted((r.a, r.b, r.distance) for r in neighbours.hamming_pairs(df, most).collect())
        assert got == sorted((i, j, d) for i, a in enumerate(points) for j, b in enumerate(points) if i < j and (d := (a ^ b).bit_count()) <= most)


def test_nearest_in_several_runs(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (60, 4)).astype(float).tolist()
    rows = [(i, v[i], i % 5, int(rng.integers(0, 8)), int(rng.integers(0, 8))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label long, train long, test long").repartition(6)
    got = {(r.run, r.id): r.nn_id for r in neighbours.nearest(df.withColumn("runs", F.col("train")), df.withColumn("runs", F.col("test")), 3).collect()}
    want = {}
    for r in range(3):
        base = [x for x in rows if x[3] >> r & 1]
        for q in (x for x in rows if x[4] >> r & 1):
            want[r, q[0]] = min(base, key=lambda x: (sum((a - b) ** 2 for a, b in zip(x[1], q[1], strict=True)), x[0]))[0]
    assert got == want


def test_folds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(10)], "id long, person long, value double")
    every = series.leave_one_out(rows, "person").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, series.fold_totals(rows, "person", "value").collect()))
    monkeypatch.setattr(series, "MOST_FOLDS", 2)
    with pytest.raises(ValueError):
        series.leave_one_out(rows, "person")


def test_passing_tables_go(spark):
    with session.passing(spark):
        gone = session.written(spark.range(3).toDF("a"), "passing")
        stays = session.written(gone, "lasting", lasting=True)
    path = lambda t: t._splitproof_path.removeprefix("file://")
    assert not os.path.exists(path(gone)) and stays.count() == 3
    session.erase(stays)
    assert not os.path.exists(path(stays)) and stays._splitproof_path not in session._PATHS
