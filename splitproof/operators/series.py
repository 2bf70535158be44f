"""Per-series features of long tables (series, frame, value): cleaning, resampling, differences, scaling, windows, balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .resampling import draw, ranked


def framed(events: DataFrame, series: str, order: list[str]) -> DataFrame:
    """V5: adds the zero-based ``frame`` of each row in its series."""
    return events.withColumn("frame", (F.row_number().over(W.partitionBy(series).orderBy(*order)) - 1).cast("long"))


def usable(rows: DataFrame, series: str, good: Column, least_share: float = 0.7, least_rows: int = 15) -> DataFrame:
    """rows of series with enough good rows and enough rows. Aggregated before the semi-join, so only series names are shuffled for it."""
    kept = rows.groupBy(series).agg(F.avg(F.when(good, 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n")).where((F.col("share") >= least_share) & (F.col("n") >= least_rows))
    return rows.join(kept.select(series), series, "left_semi")


def supported(rows: DataFrame, label: str, least: int = 30) -> DataFrame:
    """rows whose label has at least ``least`` rows."""
    kept = rows.groupBy(label).count().where(F.col("count") >= least).select(label)
    return rows.join(kept, label, "left_semi")


def resampled(rows: DataFrame, series: str, source: float, target: float) -> DataFrame:
    """Linear interpolation of (series, frame, value) from ``source`` to ``target`` frames a second: (series, frame, value).

    The grid ends before the last source frame's time. Uniform sampling makes the bracket a computed frame number, so this is an
    equi-join of each grid point with one source frame, whose successor rides along. Equal rates change nothing.
    """
    if abs(source - target) < 1e-6:
        return rows.select(series, "frame", "value")
    after = W.partitionBy(series).orderBy("frame")
    left = rows.select(series, F.col("frame").alias("at"), "value", F.lead("value").over(after).alias("following"))
    last = rows.groupBy(series).agg(F.max("frame").alias("last"))
    n = F.ceil(F.col("last") / F.lit(source) * F.lit(target) - 1e-9)
    grid = last.where(n > 0).select(series, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("frame"))
    place = F.col("frame") * F.lit(source) / F.lit(target)
    grid = grid.withColumn("at", F.floor(place + 1e-9).cast("long")).withColumn("w", F.greatest(place - F.col("at"), F.lit(0.0)))
    return grid.join(left, [series, "at"]).select(series, "frame", (F.col("value") + F.col("w") * (F.coalesce("following", "value") - F.col("value"))).alias("value"))


def differences(rows: DataFrame, series: str, value: str = "value") -> DataFrame:
    """V1, V2: adds first and second differences, edges clamped; one sort serves both."""
    w = W.partitionBy(series).orderBy("frame")
    x = F.col(value)
    before, after = F.coalesce(F.lag(value).over(w), x), F.coalesce(F.lead(value).over(w), x)
    return rows.withColumns({"d1": x - before, "d2": after - 2 * x + before})


def scaled(rows: DataFrame, series: str, values: list[str]) -> DataFrame:
    """V3: each value less its series' mean, over its population deviation plus 1e-6."""
    w = W.partitionBy(series)
    return rows.withColumns({v: (F.col(v) - F.avg(v).over(w)) / (F.stddev_pop(v).over(w) + 1e-6) for v in values})


def windows(rows: DataFrame, series: str, values: list[str], size: int = 15, step: int = 5) -> DataFrame:
    """V4: (series, start, one array a value) of each full window of ``size`` frames that starts at a multiple of ``step``."""
    w = W.partitionBy(series).orderBy("frame").rowsBetween(0, size - 1)
    made = rows.select(series, "frame", *[F.collect_list(v).over(w).alias(v) for v in values])
    return made.where((F.col("frame") % step == 0) & (F.size(values[0]) == size)).withColumnRenamed("frame", "start")


#: Persons that a leave-one-out table may have: its rows are rows times persons.
MOST_FOLDS = 1_000


def leave_one_out(rows: DataFrame, person: str) -> DataFrame:
    """Every row in every fold; its role is test in the fold of its own person. More than MOST_FOLDS persons raise ValueError: ``fold_totals`` has no such limit."""
    found = [r[0] for r in rows.select(F.col(person)).distinct().limit(MOST_FOLDS + 1).collect()]
    if len(found) > MOST_FOLDS:
        raise ValueError("too many persons for a table of rows times persons")
    out = rows.withColumn("fold", F.explode(F.array(*[F.lit(p) for p in found])))
    return out.withColumn("role", F.when(F.col(person) == F.col("fold"), "test").otherwise("train"))


def fold_totals(rows: DataFrame, person: str, value: str) -> DataFrame:
    """(fold, role, n, total) of every leave-one-out fold, from one sum for each person: train is all but the person's own."""
    own = rows.groupBy(F.col(person).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    every = own.withColumns({f"all_{c}": own.agg(F.sum(c)).scalar() for c in ("n", "total")})
    sides = F.array(F.struct(F.lit("test").alias("role"), F.col("n").alias("n"), F.col("total").alias("total")), F.struct(F.lit("train").alias("role"), (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_total") - F.col("total")).alias("total")))
    return every.select("fold", F.explode(sides).alias("x")).select("fold", "x.*").where("n > 0")


def oversampled(rows: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Each class repeated whole, and in part, up to the size of the largest: adds ``copy``. Which rows the part has is drawn at random."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).scalar()
    placed = ranked(rows.withColumn("__draw", draw(seed, key)), "__draw", key, label, out="i").drop("__draw")
    out = placed.join(counts, label).withColumn("most", most)
    copies = F.floor((F.col("most") - 1 - F.col("i")) / F.col("n"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long")))).drop("i", "n", "most")
