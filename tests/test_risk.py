"""Split-risk kernels against enumeration, golden values and each other."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from splitproof.functions import exact, risk

#: Sizes and their counts, and the sums they give among 60,000 files of which 10,000 are test.
TEN = {2: 272, 3: 8, 4: 5, 6: 2, 8: 1}
HUNDRED = {2: 752, 3: 51, 4: 17, 5: 4, 6: 5, 7: 1, 8: 1}
GOLDEN = [(TEN, 83.572778222961, 86.096712152604, 58.021486709305), (HUNDRED, 246.137378908647, 255.795196147726, 166.79682566808)]


def enumerated(population, test, groups):
    """Crossing counts and exposed files over every test set; groups are lists of files."""
    counts, files = [], []
    for chosen in combinations(range(population), test):
        inside = [len(set(chosen) & set(g)) for g in groups]
        counts.append(sum(0 < k < len(g) for k, g in zip(inside, groups, strict=True)))
        files.append(sum(k for k, g in zip(inside, groups, strict=True) if k < len(g)))
    mean = Fraction(sum(counts), len(counts))
    return mean, Fraction(sum(files), len(files)), Fraction(sum(c * c for c in counts), len(counts)) - mean**2


@pytest.mark.parametrize("population,test,sizes", [(6, 2, [2, 2]), (9, 3, [2, 3, 2]), (8, 4, [4, 3]), (10, 2, [5, 2, 3])])
def test_kernels_equal_enumeration(population, test, sizes):
    at, groups = 0, []
    for s in sizes:
        groups.append(list(range(at, at + s)))
        at += s
    histogram = {s: sizes.count(s) for s in set(sizes)}
    crossing, exposed, variance = enumerated(population, test, groups)
    assert exact.total(exact.crossing, population, test, histogram) == crossing
    assert exact.total(exact.exposed, population, test, histogram) == exposed
    assert exact.crossing_variance(population, test, histogram) == variance


@pytest.mark.parametrize("histogram,crossing,exposed,variance", GOLDEN)
def test_golden_values(spark, histogram, crossing, exposed, variance):
    assert float(exact.total(exact.crossing, 60_000, 10_000, histogram)) == pytest.approx(crossing, abs=1e-11)
    assert float(exact.total(exact.exposed, 60_000, 10_000, histogram)) == pytest.approx(exposed, abs=1e-11)
    assert float(exact.crossing_variance(60_000, 10_000, histogram)) == pytest.approx(variance, abs=1e-11)
    row = spark.createDataFrame([([(k, n) for k, n in histogram.items()],)], "h array<struct<size:long,n:long>>")
    m, t = F.lit(60_000), F.lit(10_000)
    got = row.select(risk.summed(risk.crossing, m, t, F.col("h")), risk.summed(risk.exposed, m, t, F.col("h"))).first()
    assert got[0] == pytest.approx(crossing, abs=1e-9) and got[1] == pytest.approx(exposed, abs=1e-9)


def test_golden_bounds(spark):
    p = spark.createDataFrame([(60_000, 10_000, 288, 608, None), (60_000, 10_000, 831, 1790, 8), (60_000, 10_000, 3, 5, None)], "population long, test long, groups long, files long, cap long")
    a, b, none = risk.bounds(p).collect()
    assert [a.crossing_low, a.crossing_high, a.exposed_low, a.exposed_high] == pytest.approx([80.721523147827, 84.445851875309, 85.390217614738, 86.66796297963], abs=1e-8)
    assert [b.crossing_low, b.exposed_low] == pytest.approx([241.359467548367, 253.389449655284], abs=1e-8)
    assert none.crossing_low is None


@pytest.mark.parametrize("population,test,groups,files,cap", [(20, 4, 3, 9, None), (24, 6, 4, 12, None), (30, 8, 4, 15, 6), (20, 4, 2, 9, 5)])
def test_search_equals_enumeration(population, test, groups, files, cap):
    sizes = range(2, (cap or files) + 1)
    every = [sum(exact.exposed(population, test, s) for s in a) for a in combinations_with_replacement(sizes, groups) if sum(a) == files]
    assert exact.extrema(exact.exposed, population, test, groups, files, cap) == (min(every), max(every))
    low, high = (exact.total(exact.exposed, population, test, exact.allocation(k, groups, files, cap)) for k in ("concentrated", "balanced"))
    assert (low, high) == (min(every), max(every))


def test_certificate_and_its_limits():
    found = exact.certificate(20, 4, 2, 9)
    assert all(v for v in found.values() if isinstance(v, bool))
    assert exact.allocation("concentrated", 2, 9) == {2: 1, 7: 1} and exact.allocation("balanced", 2, 9) == {4: 1, 5: 1}
    with pytest.raises(ValueError):
        exact.certificate(20, 11, 3, 9)
    with pytest.raises(ValueError):
        exact.allocation("concentrated", 3, 20, 4)


def test_mergers_lower_crossing_and_raise_exposure():
    for population in (12, 20, 30):
        for test in range(1, population // 2):
            for a in range(2, 6):
                for b in range(2, 6):
                    c, e = exact.merge_change(population, test, a, b)
                    assert c <= 0 <= e
                    assert exact.merge_change(population, test, a, 1)[0] >= 0
    path = exact.greedy_merges(1000, 100, {2: 30, 3: 5, 5: 2}, "crossing")
    assert len(path) == 25 and all(x[3] >= y[3] and x[4] <= y[4] for x, y in zip(path, path[1:], strict=False))
