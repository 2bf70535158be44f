"""Operator 6, line dedup (DataFrame functions only): explode normalised lines, hash, count distinct documents per hash, drop
lines over the threshold and reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, pick

#: A key is heavy if it holds more than this share of all lines, so there are fewer than its inverse.
HEAVY_SHARE = 1e-4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_frequent_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, and the columns ``n_lines`` and ``n_dropped`` (long) after its own.

    A line's key is the line without white space (tab to carriage return, space) at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_documents`` documents (distinct doc_id) lose all their lines. A null or empty
    text is one empty line and comes out as the empty text. All columns are kept, whatever their names (one named n_lines or
    n_dropped stands beside ours). Rows that repeat a doc_id count as one document and are each returned; a null doc_id counts as
    one document too. An empty table gives no rows.

    Two 64-bit hashes stand for a key. Texts are read twice for their lines, whose hashes are counted and then looked up; nothing is
    written between. Keys too frequent for one task, in however few documents, are fewer than 1 / HEAVY_SHARE by arithmetic and
    looked up through a broadcast; the others by an ordinary join, which heavy lines pass under keys of their own. Texts are
    shuffled once.
    """
    slim = pick(docs, doc_id="doc_id", text="text")
    exploded = slim.select("doc_id", _row_key(F.col("text")).alias("row_key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = exploded.select("doc_id", "row_key", "pos", ascii_lower(F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = key.select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))

    counted = hashed.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("h1", "h2").agg((F.count(F.lit(1)) >= min_documents).alias("frequent"), F.sum("n").alias("lines"))
    judged = counted.withColumn("heavy", F.col("lines") > HEAVY_SHARE * counted.agg(F.sum("lines")).scalar())
    heavy = judged.where("heavy").select("h1", "h2", F.col("frequent").alias("known"))
    rest = judged.where(~F.col("heavy") & F.col("frequent")).select("h1", "h2", F.lit(True).alias("found"))
    looked = hashed.join(F.broadcast(heavy), ["h1", "h2"], "left")
    spread = F.when(F.col("known").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "doc_id", "row_key", "pos"))
    hits = looked.withColumn("h1", spread).join(rest, ["h1", "h2"], "left").where(F.coalesce("known", "found", F.lit(False)))
    dropped = hits.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("gone")).toDF("__id", "__row", "__gone")

    n, at = len(docs.columns), {c: f"__c{docs.columns.index(c)}" for c in ("doc_id", "text")}
    rows = numbered(docs).withColumn("__key", _row_key(F.col(at["text"])))
    rows = rows.join(dropped, rows[at["doc_id"]].eqNullSafe(dropped["__id"]) & (rows["__key"] == dropped["__row"]), "left")
    rows = rows.withColumn("__lines", _lines(F.col(at["text"]))).withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.size("__gone") == 0, F.coalesce(F.col(at["text"]), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    out = [kept if f"__c{i}" == at["text"] else F.col(f"__c{i}") for i in range(n)]
    named = rows.select(*[c.alias(f"__o{i}") for i, c in enumerate(out)], F.size("__lines").cast("long"), F.size("__gone").cast("long"))
    return named.toDF(*docs.columns, "n_lines", "n_dropped")
