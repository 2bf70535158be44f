"""Batch plans of the event-time operators over ``events``; tests run the same operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import branches as op
from .catalog import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


@query("""SELECT user_id, epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, arg_min(event_id, (ts, event_id)) AS event_id, round(arg_min(value, (ts, event_id)), 9) AS value FROM events GROUP BY 1, 2""")
def first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2 with a period of a day."""
    return op.fired(events(spark, sf_dir), "1 day").select("user_id", F.unix_timestamp("start").alias("start"), "event_id", F.round("value", 9).alias("value"))


@query("""SELECT user_id, epoch(time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01'))::BIGINT + 10800 AS at, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def three_hour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X4 with a period of three hours."""
    return op.emitted(events(spark, sf_dir), "3 hours").select("user_id", F.unix_timestamp("at").alias("at"), "n", F.round("total", 6).alias("total"))


@query("SELECT event_id, " + ", ".join(f"coalesce(round(last_value(CASE WHEN event_type = '{b}' THEN value END IGNORE NULLS) OVER w, 9), -1) AS \"{b}\"" for b in op.BRANCHES) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5, X6; -1 stands for a branch without a value."""
    out = op.latest_batch(events(spark, sf_dir), op.BRANCHES)
    return out.select("event_id", *[F.coalesce(F.round(F.col(b), 9), F.lit(-1.0)).alias(b) for b in op.BRANCHES])


@query("""SELECT user_id, epoch(time_bucket(INTERVAL '1500 milliseconds', ts, TIMESTAMP '1970-01-01')) AS start, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'click' AND value >= 10 GROUP BY 1, 2""")
def gated_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reference's period of 1.5 seconds, and a gate."""
    out = op.fired(events(spark, sf_dir), "1500 milliseconds", gate=(F.col("event_type") == "click") & (F.col("value") >= 10))
    return out.select("user_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', start)") / 1e6).alias("start"), "event_id")


@query("""SELECT user_id, epoch(time_bucket(INTERVAL '3 seconds', ts, TIMESTAMP '1970-01-01'))::BIGINT + 3 AS at, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def three_second_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reference's period of three seconds."""
    return op.emitted(events(spark, sf_dir), "3 seconds").select("user_id", F.unix_timestamp("at").alias("at"), "n", F.round("total", 6).alias("total"))


@query("WITH l AS (SELECT event_id, " + ", ".join(f"last_value(CASE WHEN event_type = '{b}' THEN value END IGNORE NULLS) OVER w AS \"{b}\"" for b in op.BRANCHES) + """ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT event_id, list_filter([""" + ", ".join(f"{{'v': \"{b}\", 'i': {-i}, 'name': '{b}'}}" for i, b in enumerate(op.BRANCHES)) + """], lambda x: x.v IS NOT NULL) AS known FROM l)
SELECT event_id, list_max(known).name AS zone, round(list_max(known).v, 9) AS confidence, array_to_string(list_transform(known, lambda x: x.name || '=' || round(x.v)::BIGINT), ', ') AS reasoning FROM k""")
def fused_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches' last values as one record."""
    out = op.fused(op.latest_batch(events(spark, sf_dir), op.BRANCHES), op.BRANCHES)
    return out.select("event_id", F.col("record.zone").alias("zone"), F.round("record.confidence", 9).alias("confidence"), F.col("record.reasoning").alias("reasoning"))
