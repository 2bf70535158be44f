"""What the operators of this subpackage share: tables, exact column picking, ASCII lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import erase, passing, ship, written

__all__ = ["ascii_lower", "erase", "numbered", "passing", "pick", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The frame with its columns renamed by position, so that names that clash (also but for case) can't be ambiguous."""
    ship(df.sparkSession)
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns whose names are exactly the values given, under the names of the arguments."""
    return numbered(df).select(*[F.col(f"__c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same, faster, where every character is ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))
