"""The canonical record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, tree, label, split, sha256 from ``documents``; 15 % of the ids, by a multiplicative hash, are the test split."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    split = F.when((F.col("doc_id") * 2654435761) % 100 < 15, "test").otherwise("train")
    return docs.select(F.col("doc_id").alias("rel"), F.col("lang").alias("tree"), F.col("source").alias("label"), split.alias("split"), F.sha2("text", 256).alias("sha256"))
