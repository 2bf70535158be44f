"""Streams against the batch plans of the same operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from splitproof.plans.streams import events
from splitproof.streaming import branches as op


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events in four files by time, one a micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need the type with a zone
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return path, rows


def ran(spark, out, mode, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def source(spark, parts):
    return spark.readStream.schema(parts[1].schema).option("maxFilesPerTrigger", 1).parquet(parts[0])


def test_latest_values(spark, parts, tmp_path):
    got = ran(spark, op.latest_stream(source(spark, parts), op.BRANCHES), "append", tmp_path, "latest")
    assert len(got) == parts[1].count()


def test_fired_periods(spark, parts, tmp_path):
    got = ran(spark, op.fired(source(spark, parts), "1 day"), "complete", tmp_path, "fired")
    assert got == sorted(map(tuple, op.fired(parts[1], "1 day").collect()))


def test_deduplicated_and_flagged(spark, parts, tmp_path):
    known = spark.createDataFrame([(3,)], "user_id long")
    got = ran(spark, op.flagged(op.deduplicated(source(spark, parts), "60 days"), known, "user_id"), "append", tmp_path, "flagged")
    assert len(got) == parts[1].count() and sum(r[-1] for r in got) == parts[1].where("user_id = 3").count()


def test_sessions(spark, parts, tmp_path):
    got = ran(spark, op.sessions(source(spark, parts).withWatermark("ts", "1 hour"), "30 minutes"), "complete", tmp_path, "sessions")
    assert sum(r[-1] for r in got) == parts[1].count()
