"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import count_tokens, with_tokens
from .common import pick, table
from .decontaminate import contamination
from .language import identify
from .line_dedup import drop_frequent_lines
from .order_minhash import fingerprint_documents
from .pii import pseudonymise
from .sharding import shard_documents
from .simhash import hex_fingerprint, near_groups
from .suffix_dedup import remove_repeats
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]

#: Production keys come from the caller; this one makes the registered query repeatable.
PSEUDONYM_KEY = "demonstration key"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op4_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = with_tokens(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), TOKENIZER)
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hash_tree_shards, op2_order_minhash, op3_simhash_mih, op4_suffix_array_decontamination, op5_language_id, op6_line_dedup, op7_bpe_backtracking, op8_prefix_free_dedup, op9_token_counts, op10_feistel_pseudonyms)}
