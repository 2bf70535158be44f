"""Operators on small tables with known results."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitproof.operators import audit, graph, metrics, neighbours, resampling, series


def cells(spark, matrix):
    return spark.createDataFrame([(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n], "truth long, pred long, n long")


#: Confusion matrices, their kappa and recalls.
@pytest.mark.parametrize(
    "matrix,kappa,recalls",
    [
        ([[2556, 103, 101], [89, 921, 210], [162, 199, 679]], 0.709519925097546, (0.9261, 0.7549, 0.6529)),
        ([[121, 8, 9], [42, 12, 7], [35, 14, 3]], 0.11497777096428018, (0.8768, 0.1967, 0.0577)),
        ([[138, 0, 0], [61, 0, 0], [52, 0, 0]], 0.0, (1, 0, 0)),
    ],
)
def test_golden_kappa(spark, matrix, kappa, recalls):
    c = cells(spark, matrix)
    assert metrics.summary(c).first().kappa == pytest.approx(kappa, abs=1e-9)
    assert [r.recall for r in metrics.per_class(c).orderBy("class").collect()] == pytest.approx(recalls, abs=5e-5)


def test_class_never_predicted_counts_as_zero(spark):
    c = cells(spark, [[0, 2], [0, 3]])
    s = metrics.summary(c).first()
    assert s.balanced_accuracy == 0.5 and s.macro_f1 == pytest.approx(0.375)
    assert metrics.fixed_label_means(c, spark.range(3).select(F.col("id").alias("class"))).first().uar == pytest.approx(1 / 3)
    assert metrics.dense(c, spark.range(2).select(F.col("id").alias("class"))).count() == 4


def test_chance_correction(spark):
    row = spark.range(1).select(metrics.chance_corrected(F.lit(0.2817), 6), metrics.chance_corrected(F.lit(0.4512), 3)).first()
    assert list(row) == pytest.approx([0.13804, 0.1768])


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    random.seed(seed)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    got = graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == union_find(edges)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_edge_omissions(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (20, 22)], "src long, dst long")
    left = {(r.src, r.dst): list(r.left) for r in graph.edge_omissions(edges, graph.components(edges)).collect()}
    assert left == {(1, 2): [3], (2, 3): [2, 2], (3, 4): [3], (10, 11): [], (20, 21): [3], (21, 22): [3], (20, 22): [3]}


@pytest.mark.parametrize("most", [0, 2, 4])
def test_banded_pairs_equal_all_pairs(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(-(2**62), 2**62, 30)
    bits = np.unique(np.concatenate([base] + [base ^ (1 << int(k)) ^ (1 << int(j)) for k, j in rng.integers(0, 63, (8, 2))]))
    got = {(r.a, r.b, r.distance) for r in neighbours.hamming_pairs(spark.createDataFrame([(i, int(b)) for i, b in enumerate(bits)], "id long, bits long"), most).collect()}
    want = {(i, j, int(np.bitwise_count(np.uint64((int(bits[i]) ^ int(bits[j])) & (2**64 - 1))))) for i in range(len(bits)) for j in range(i + 1, len(bits))}
    assert got == {w for w in want if w[2] <= most}


def test_partitions_and_overlap(spark):
    five = spark.createDataFrame([(x,) for x in "abcde"], "label string")
    assert audit.partitions_2_2_1(five).select("partition").distinct().count() == 15
    rows = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "1"), ("z", "3")], "tree string, sha256 string")
    assert [tuple(r) for r in audit.overlap(rows, "tree").collect()] == [("x", "y", 1, 1.0)]


def test_stem(spark):
    df = spark.createDataFrame([("A/Face_AUG_12.PNG",), ("b.jpg",), ("c_aug_1_aug_2.jpg",)], "p string")
    assert [r[0] for r in df.select(audit.stem(F.col("p"))).collect()] == ["a/face", "b", "c_aug_1"]


def values(df, *cols):
    return [tuple(r) for r in df.orderBy("frame").select(*cols).collect()]


def test_differences_clamp_edges(spark):
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate([1, 2, 4, 7])], "series string, frame long, value double")
    assert values(series.differences(df, "series"), "d1", "d2") == [(0, 1), (1, 1), (2, 1), (3, -3)]


def test_windows_are_full(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(25)] + [("b", i, 0.0) for i in range(14)], "series string, frame long, value double")
    got = series.windows(df, "series", ["value"]).orderBy("start").collect()
    assert [(r.series, r.start, r.value[0], len(r.value)) for r in got] == [("a", 0, 0.0, 15), ("a", 5, 5.0, 15), ("a", 10, 10.0, 15)]


def test_resampling_equals_interpolation(spark):
    x = np.random.default_rng(1).normal(size=40)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, frame long, value double")
    got = values(series.resampled(df, "series", 30.0, 25.0), "value")
    grid = np.arange(0, 39 / 30, 1 / 25)
    assert np.allclose([v for (v,) in got], np.interp(grid, np.arange(40) / 30, x))
    assert series.resampled(df, "series", 30.0, 30.0).count() == 40


def test_constant_channel_scales_to_zero(spark):
    df = spark.createDataFrame([("s", i, 5.0) for i in range(4)], "series string, frame long, value double")
    assert values(series.scaled(df, "series", ["value"]), "value") == [(0.0,)] * 4


def test_oversampling(spark):
    df = spark.createDataFrame([(f"a{i}", "a") for i in range(5)] + [("b0", "b"), ("b1", "b")], "id string, label string")
    got = series.oversampled(df, "label", "id").groupBy("label", "id").count().collect()
    assert {r.id: r["count"] for r in got} == {**{f"a{i}": 1 for i in range(5)}, "b0": 3, "b1": 2}


def test_ranked_places_are_a_permutation(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("d", resampling.draw(1, "id"))
    got = resampling.ranked(rows, "d", "id", "g").toPandas()
    for _, part in got.groupby("g"):
        assert list(part.sort_values(["d", "id"]).place) == list(range(len(part)))


def test_group_split_never_cuts_a_group(spark):
    rows = spark.range(300).withColumn("component", F.floor(F.col("id") / 7))
    out = resampling.group_split(rows, "component", spark.range(4).withColumnRenamed("id", "seed"))
    assert out.groupBy("seed", "component").agg(F.count_distinct("role").alias("k")).where("k > 1").count() == 0
    assert {r.n for r in out.where("role = 'test'").groupBy("seed").agg(F.count_distinct("component").alias("n")).collect()} == {6}


def test_matched_sample_refuses_small_pools(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(5)], "id long, label string")
    ask = lambda n: spark.createDataFrame([("a", n)], "label string, n long")
    assert resampling.matched_sample(rows, "id", "label", ask(3)).count() == 3
    with pytest.raises(Exception, match="too few rows"):
        resampling.matched_sample(rows, "id", "label", ask(6)).collect()


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = spark.createDataFrame(pd.DataFrame({"id": range(50), "vector": [list(map(float, v)) for v in rng.normal(size=(50, 4))], "label": [i % 3 for i in range(50)]}))
    queries = spark.createDataFrame(pd.DataFrame({"id": range(100, 120), "vector": [list(map(float, v)) for v in rng.normal(size=(20, 4))]}))
    one = sorted(map(tuple, neighbours.nearest(base, queries).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, neighbours.nearest(base, queries).collect())) == one
