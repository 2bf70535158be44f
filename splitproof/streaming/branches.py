"""Event-time versions of frame-triggered pipelines: what fires in each period, and the last value of each branch.

``latest_*`` come as a batch plan and as a streaming one over the same events; a test holds one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Branches of the fused record, in the order of its columns.
BRANCHES = ("view", "click", "purchase", "signup", "error")


def fired(events: DataFrame, period: str, order: str = "ts", gate: Column | None = None) -> DataFrame:
    """The first event of each user in each tumbling period: (user_id, start, event_id, value). With a ``gate`` only events
    that pass it fire. Works on streams too."""
    events = events if gate is None else events.where(gate)
    first = F.struct(order, "event_id", "value")
    out = events.groupBy(F.window("ts", period).alias("w"), "user_id").agg(F.min(first).alias("f"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("f.event_id").alias("event_id"), F.col("f.value").alias("value"))


def emitted(events: DataFrame, period: str) -> DataFrame:
    """At the end of each period, how much it held: (user_id, at, n, total). Works on streams too."""
    out = events.groupBy(F.window("ts", period).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.end").alias("at"), "n", "total")


def latest_batch(events: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """With each event the last value of every branch of its user so far, null until the first."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    own = lambda b: F.last(F.when(F.col("event_type") == b, F.col("value")), ignorenulls=True).over(w).alias(b)
    return events.select("user_id", "event_id", "ts", *[own(b) for b in branches])


def fused(latest: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """One struct of all branches with what they say together: the branch of the greatest value (ties: the first), that value, and a line of reasons."""
    known = F.filter(F.array(*[F.struct(F.col(b).alias("v"), F.lit(-i).alias("i"), F.lit(b).alias("name")) for i, b in enumerate(branches)]), lambda x: x["v"].isNotNull())
    best = F.array_max(known)
    reasons = F.array_join(F.transform(known, lambda x: F.concat(x["name"], F.lit("="), F.round(x["v"]).cast("long").cast("string"))), ", ")
    record = F.struct(*branches, best["name"].alias("zone"), best["v"].alias("confidence"), reasons.alias("reasoning"))
    return latest.withColumn("record", record)


def latest_stream(events: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """X5, X6 over a stream: the state of a user is one value for each branch. Events of one micro-batch are taken in order of time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["user_id", "event_id", "ts", *branches]
    schema = "user_id long, event_id long, ts timestamp, " + ", ".join(f"`{b}` double" for b in branches)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None] * len(branches)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            if r.event_type in branches:
                now[branches.index(r.event_type)] = float(r.value)
            out.append((r.user_id, r.event_id, r.ts, *now))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("user_id").applyInPandasWithState(step, schema, ", ".join(f"`{b}` double" for b in branches), "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """An extension: each event_id once, state kept as long as the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def flagged(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """An extension: a stream against a static table of keys, as a left join that marks what is known."""
    return events.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left").fillna(False, ["known"])


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """An extension: session windows by user."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
