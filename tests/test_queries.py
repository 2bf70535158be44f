"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from splitproof.plans import load

CATALOG = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(CATALOG.SQL))
def test_query_equals_sql(name, spark, sf, duck):
    out = CATALOG.QUERIES[name](spark, sf)
    want = duck.execute(CATALOG.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(out.columns) == sorted(columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(CATALOG.QUERIES) - set(CATALOG.SQL)))
def test_other_queries_give_rows(name, spark, sf):
    assert CATALOG.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(partitions, spark, sf):
    names = ["split_protocols", "leakage_groups", "permutation_null", "near_hash_pairs"]
    first = {n: sorted(map(tuple, CATALOG.QUERIES[n](spark, sf).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {n: sorted(map(tuple, CATALOG.QUERIES[n](spark, sf).collect())) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
