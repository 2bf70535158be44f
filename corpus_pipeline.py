"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, tokens. Each stage works on all that its predecessor kept.

In every stage a row that repeats another is treated as that one is, rows without a doc_id are kept by the same rules, columns of
any name, also clashing ones, are passed on, and an empty table gives an empty one. What a null or empty text and ties mean stands
with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitproof.llm.bpe import with_tokens
from splitproof.llm.common import erase, passing, table, written
from splitproof.llm.decontaminate import drop_contaminated
from splitproof.llm.language import keep_identified
from splitproof.llm.line_dedup import drop_frequent_lines
from splitproof.llm.near_copies import drop_near_copies
from splitproof.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose text is null, empty or has no letter go, as their language can't be told (``und``). All others stay,
    also those of which no learned language knows anything; where nothing could be learned, none does."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines found in ten documents or more go from all; n_chars follows the text. A null text is one empty line and becomes
    the empty text; empty lines are never frequent; a document all of whose lines go stays, with an empty text."""
    n = len(docs.columns)
    out = drop_frequent_lines(docs).toDF(*[f"__c{i}" for i in range(n + 2)])
    text = f"__c{docs.columns.index('text')}"
    cols = [F.char_length(text).cast(kind).alias(f"__c{i}") if name == "n_chars" else F.col(f"__c{i}") for i, (name, kind) in enumerate(docs.dtypes)]
    return out.select(*cols).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies, five-word shingles and Jaccard similarity 0.8: one document of each group stays, the one with the least doc_id.

    Null, empty and wordless texts are copies of each other. Rows that repeat the doc_id that stays all stay; rows without a doc_id
    stay only where their group has no doc_id.
    """
    return drop_near_copies(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents go if a twentieth of their words or more lie in windows of the benchmark. Null, empty and wordless texts stay,
    and without a benchmark all do."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: all columns, the tokens, their number, and whether decoding gives the text back. Null and empty texts have none, and give back the empty text."""
    names = [*docs.columns, "n_tokens", "ids", "round_trip"]
    out = with_tokens(docs, TOKENIZER, keep=False)
    out = out.toDF(*[f"__c{i}" for i in range(len(out.columns))])
    kept = [F.col(f"__c{i}") for i in range(len(names) - 1)]
    same = F.col(f"__c{len(names) - 1}") == F.coalesce(F.col(f"__c{docs.columns.index('text')}"), F.lit(""))
    return out.select(*kept, same.alias("__same")).toDF(*names)


STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near_copies", near_copies), ("contaminated", contaminated), ("tokens", tokens)]

#: SQL can't express the shingles' hashes or the tokenizer; test_pipeline holds the rows of run() against a plain implementation of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again as the next one's input. A stage's own tables go when its output is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
        if before is not None:
            erase(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
