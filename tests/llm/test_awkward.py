"""Every operator and stage on awkward rows, on no rows, and on tables with more columns and names that clash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from awkward import AWKWARD
from splitproof.llm.bpe import count_tokens, with_tokens
from splitproof.llm.decontaminate import contamination, drop_contaminated
from splitproof.llm.language import identify, keep_identified
from splitproof.llm.line_dedup import drop_frequent_lines
from splitproof.llm.order_minhash import fingerprint_documents
from splitproof.llm.pii import pseudonymise, pseudonymised
from splitproof.llm.queries import TOKENIZER
from splitproof.llm.sharding import Shard, shard_documents, topology
from splitproof.llm.simhash import drop_near_copies, near_groups
from splitproof.llm.suffix_dedup import remove_repeats


def bench(df):
    return df.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 5")


PER_ROW = {
    "shards": shard_documents,
    "fingerprints": fingerprint_documents,
    "near": near_groups,
    "contamination": lambda d: contamination(d, bench(d.toDF(*[c if c != "Text" else "x" for c in d.columns]))),
    "language": identify,
    "lines": drop_frequent_lines,
    "tokens": lambda d: with_tokens(d, TOKENIZER),
    "repeats": remove_repeats,
    "counts": lambda d: count_tokens(d, TOKENIZER),
    "pseudonyms": lambda d: pseudonymise(d, "key"),
    "pseudonymised": lambda d: pseudonymised(d, "key"),
}
FILTERS = {"keep_identified": keep_identified, "drop_near_copies": drop_near_copies, "drop_contaminated": lambda d: drop_contaminated(d, bench(d.toDF(*[c if c != "Text" else "x" for c in d.columns])))}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(name, awkward, nothing, clashing):
    want = sorted((str(x[0]) for x in AWKWARD))
    for table in (awkward, clashing):
        out = PER_ROW[name](table)
        ids = out.toDF(*[f"{c}-{i}" if c != "doc_id" else c for i, c in enumerate(out.columns)]).select("doc_id").collect()
        assert sorted(str(r[0]) for r in ids) == want
    assert PER_ROW[name](nothing).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(name, awkward, nothing, clashing):
    for table in (awkward, clashing):
        out = FILTERS[name](table)
        assert out.columns == table.columns and [t for _, t in out.dtypes] == [t for _, t in table.dtypes]
        assert 0 < out.count() < len(AWKWARD)
    assert FILTERS[name](nothing).count() == 0


def test_equal_texts_get_equal_results(awkward):
    by = {}
    for name in ("tokens", "repeats", "counts", "pseudonyms", "fingerprints"):
        for r in PER_ROW[name](awkward).collect():
            if r.doc_id == 1:
                by.setdefault(name, []).append({k: v for k, v in r.asDict().items() if k not in ("near_next", "near_edited", "edited_sha256", "edited_fingerprint")})
    assert all(len(v) == 2 and v[0] == v[1] for v in by.values())


def test_stages(spark, sf, awkward, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "contaminated", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (docs, awkward.withColumn("n_chars", F.char_length("text").cast("long")), nothing.withColumn("n_chars", F.lit(0).cast("long"))):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, sf)
            if name != "tokens":
                assert now.columns == rows.columns and now.dtypes == rows.dtypes
        assert now.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
        assert now.count() <= before.count()
    assert corpus_pipeline.run(spark, sf).count() > 0.8 * docs.count()


def test_weights_change_only_their_subtrees(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = lambda shards: {r.doc_id: (r.region, r.rack, r.shard) for r in shard_documents(docs, shards).collect()}
    old = topology(16)
    new = [Shard(s.shard, s.region, s.rack, 2.0 if s.shard == 5 else s.weight, s.generation) for s in old]
    a, b = place(old), place(new)
    moved = {d for d in a if a[d] != b[d]}
    home = next((s.region, s.rack) for s in old if s.shard == 5)
    assert moved and all(b[d][2] == 5 or (b[d][0], b[d][1]) == home or b[d][0] == home[0] for d in moved)
    grown = {r.doc_id: r.grown_shard for r in shard_documents(docs, old).collect()}
    changed = [d for d in a if grown[d] != a[d][2]]
    assert all(grown[d] == 16 for d in changed) and 100 < len(changed) < 400
