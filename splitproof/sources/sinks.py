"""Sinks: deterministic documents, tables, partitioned copies, macros and ledgers, and checks against what was frozen."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document(rows: DataFrame, most: int = 10_000) -> str:
    """K1: a small result as JSON, keys and rows in order, two spaces, one line feed at the end. More than ``most`` rows belong into ``tables``."""
    found = [json.loads(s) for s in rows.toJSON().take(most + 1)]
    if len(found) > most:
        raise ValueError("too many rows for one document")
    found.sort(key=lambda r: json.dumps(r, sort_keys=True))
    return json.dumps(found, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def manifest(rows: DataFrame, path: str) -> None:
    """K2, K4: CSV with a header."""
    rows.write.csv(path, header=True)


def table(rows: DataFrame, path: str) -> None:
    """K3: compressed columns."""
    rows.write.option("compression", "zstd").parquet(path)


def missing(rows: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """The rows that an earlier run hasn't written."""
    return rows.join(written.select(key).distinct(), key, "left_anti")


def partitioned(rows: DataFrame, path: str, key: str, *by: str) -> int:
    """K5: appends the rows that ``path`` doesn't hold yet, in folders by ``by``; gives their number. A second run writes nothing."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = missing(rows, spark.read.parquet(path), key)
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy(*by).parquet(path)
    return n


def placed(rows: DataFrame, root: str, most: int = 10_000) -> int:
    """K5: each (rel, content) as a file of its own below ``root``; those that stand there stay. Gives how many were written. More than
    ``most`` small files belong into ``partitioned``."""
    spark = rows.sparkSession
    found = rows.select("rel", F.col("content").cast("binary")).take(most + 1)
    if len(found) > most:
        raise ValueError("too many files to be placed one by one")
    path, n = spark._jvm.org.apache.hadoop.fs.Path, 0
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in found:
        target = path(f"{root}/{r.rel}")
        if not fs.exists(target):
            out = fs.create(target, False)
            out.write(bytearray(r.content))
            out.close()
            n += 1
    return n


def macros(rows: DataFrame, name: str, value: str) -> DataFrame:
    """K7: one text macro a row, numbers with separators and three places where they have any."""
    number = F.col(value)
    shown = F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 3))
    return rows.select(F.concat(F.lit("\\newcommand{\\"), F.col(name), F.lit("}{"), shown, F.lit("}")).alias("line"))


def ledger(texts: DataFrame) -> DataFrame:
    """K8: (name, value, source) of the macros in whole texts (column ``value``); source is the text's SHA-256."""
    lines = texts.select(F.sha2("value", 256).alias("source"), F.explode(F.split("value", "\n")).alias("line"))
    pattern = r"^\\newcommand\{\\([A-Za-z]+)\}\{(.*)\}$"
    name, value = (F.regexp_extract("line", pattern, i) for i in (1, 2))
    return lines.where(F.col("line").rlike(pattern)).select(name.alias("name"), value.alias("value"), "source")


def differences(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, counted with repeats; empty if the result is what was frozen."""
    names = sorted(rows.columns)
    a, b = rows.select(*names), frozen.select(*names)
    return a.exceptAll(b).withColumn("side", F.lit("new")).unionByName(b.exceptAll(a).withColumn("side", F.lit("frozen")))


def listed(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines ``hash  path`` against (path, sha256): what is missing, extra, changed, or leaves its folder."""
    want = lines.select(F.regexp_extract("line", r"^([0-9a-f]{64})  (.+)$", 1).alias("want"), F.regexp_extract("line", r"^([0-9a-f]{64})  (.+)$", 2).alias("path")).where("path <> ''")
    both = want.join(files, "path", "full")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    state = F.when(unsafe, "unsafe").when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("sha256"), "changed").otherwise("same")
    return both.select("path", state.alias("state"))
