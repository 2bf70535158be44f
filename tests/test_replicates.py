"""The tests with the reference's number of replicates; test_queries.py holds them against their SQL."""

from __future__ import annotations

from splitproof.plans import load

CATALOG = load()


def test_permutations_are_2000(spark, sf):
    r = CATALOG.QUERIES["permutation_test_2000"](spark, sf).first()
    assert r.replicates == 2000 and r.floor == round(1 / 2001, 9)
