"""Operator 9's counts don't depend on which pre-tokens its sample finds frequent."""

from __future__ import annotations

from splitproof.llm import bpe
from splitproof.llm.queries import TOKENIZER


def test_counts_are_the_same_without_the_sample(spark, awkward, monkeypatch):
    want = sorted(map(str, bpe.count_tokens(awkward, TOKENIZER).collect()))
    other = spark.createDataFrame([("zq zq unrelated words",)], "text string")
    for table in (bpe.frequent_pieces(other, TOKENIZER), bpe.frequent_pieces(other.limit(0), TOKENIZER)):
        monkeypatch.setattr(bpe, "frequent_pieces", lambda docs, path, table=table: table)
        assert sorted(map(str, bpe.count_tokens(awkward, TOKENIZER).collect())) == want
