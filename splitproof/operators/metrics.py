"""Classification metrics from long confusion tables (group columns, truth, pred, n); nothing here re-reads predictions.

A group's table is (number of classes) squared rows however many predictions it sums, so metrics are computed on aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """(by, truth, pred, n); pooled over whatever ``by`` leaves out."""
    return predictions.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def dense(cells: DataFrame, classes: DataFrame, *by: str) -> DataFrame:
    """A10: every (truth, pred) of the ``classes`` (column ``class``), with 0 where there is none."""
    one = F.lit(1).alias("one")
    true, pred = (classes.select(F.col("class").alias(n), one) for n in ("truth", "pred"))
    grid = true.join(pred, "one")
    if by:
        grid = cells.select(*by).distinct().withColumn("one", F.lit(1)).join(F.broadcast(grid), "one")
    return grid.drop("one").join(cells, [*by, "truth", "pred"], "left").fillna(0, ["n"])


def per_class(cells: DataFrame, *by: str) -> DataFrame:
    """(by, class, tp, support, predicted, precision, recall, f1) over classes that are true or predicted; 0 where a ratio has no denominator."""
    sides = cells.select(*by, F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    other = cells.select(*by, F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    out = sides.unionByName(other).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))})


def summary(cells: DataFrame, *by: str) -> DataFrame:
    """N, accuracy, balanced accuracy (mean recall of the classes that are true), macro F1 (of those true or predicted), Cohen's
    kappa (0 where the expected agreement is 1)."""
    c = per_class(cells, *by)
    out = c.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("hits"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"),
    )
    n = F.col("n").cast("double")
    observed, expected = F.col("hits") / n, F.col("chance") / (n * n)
    kappa = F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(0.0)
    return out.select(*by, "n", *[F.round(v, 9).alias(k) for k, v in (("accuracy", observed), ("balanced_accuracy", F.col("balanced_accuracy")), ("macro_f1", F.col("macro_f1")), ("kappa", kappa))])


def fixed_label_means(cells: DataFrame, classes: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean F1 and recall over a fixed list of classes (column ``class``); a class that never occurs counts as 0."""
    found = per_class(cells, *by)
    every = classes.select("class").withColumn("one", F.lit(1))
    groups = cells.select(*by).distinct().withColumn("one", F.lit(1)) if by else cells.sparkSession.range(1).select(F.lit(1).alias("one"))
    grid = groups.join(F.broadcast(every), "one").drop("one").join(found, [*by, "class"], "left").fillna(0.0, ["f1", "recall"])
    return grid.groupBy(*by).agg(F.round(F.avg("f1"), 9).alias("uf1"), F.round(F.avg("recall"), 9).alias("uar"))


def chance_corrected(value: Column, classes: Column | int) -> Column:
    """(v - 1/k) / (1 - 1/k)."""
    k = classes if isinstance(classes, Column) else F.lit(classes)
    return (value - 1.0 / k) / (1.0 - 1.0 / k)


def spread(scores: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, sample deviation (0 for a single value), population deviation, median, exact 2.5, 95 and 97.5 percent points, range."""
    v = F.col(value)
    points = {f"p{str(p).replace('.', '_')}": F.percentile(v, F.lit(p / 100)) for p in (2.5, 50, 95, 97.5)}
    stats = {"mean": F.avg(v), "std_sample": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "std_population": F.stddev_pop(v), **points, "range": F.max(v) - F.min(v)}
    return scores.groupBy(*by).agg(F.count(v).alias("n"), *[F.round(x, 9).alias(k) for k, x in stats.items()])


def class_weights(counts: DataFrame, beta: float = 0.9999) -> DataFrame:
    """From (class, n): n / total, inverse frequency scaled to mean 1, effective number scaled to mean 1, total / n."""
    every = W.partitionBy(F.lit(0))
    inverse, effective = 1.0 / F.col("n"), (1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("n")))
    return counts.select("class", "n", *[F.round(x, 9).alias(k) for k, x in (("share", F.col("n") / F.sum("n").over(every)), ("inverse", inverse / F.avg(inverse).over(every)), ("effective", effective / F.avg(effective).over(every)), ("ratio", F.sum("n").over(every) / F.col("n")))])


def median_run(scores: DataFrame, value: str, run: str, *by: str) -> DataFrame:
    """V9: the run in the middle of each group's order (the upper one of two)."""
    w = W.partitionBy(*by)
    ranked = scores.withColumn("__i", F.row_number().over(w.orderBy(value, run)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__i") == F.floor(F.col("__n") / 2)).drop("__i", "__n")


def best_by(rows: DataFrame, pick: str, keys: list[tuple[str, bool]], *by: str) -> DataFrame:
    """The ``pick`` of the best row of each group; keys: (column, whether larger is better), numeric, first key first."""
    order = F.struct(*[(F.col(c) if up else -F.col(c)).alias(f"k{i}") for i, (c, up) in enumerate(keys)])
    return rows.groupBy(*by).agg(F.max_by(pick, order).alias(pick))


def repaired(predictions: DataFrame, column: str, known: list[str], fallback: str, failed: str = "error") -> DataFrame:
    """without the rows whose prediction failed; predictions that aren't known become the fallback."""
    rows = predictions.where(F.col(column) != failed)
    return rows.withColumn(column, F.when(F.col(column).isin(known), F.col(column)).otherwise(fallback))


def over_runs(scores: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation (0 for a single run) of the measures that ``summary`` gives, over the runs of each group."""
    measures = ("accuracy", "balanced_accuracy", "macro_f1", "kappa")
    stats = [f(m) for m in measures for f in (lambda m: F.round(F.avg(m), 7).alias(f"{m}_mean"), lambda m: F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 7).alias(f"{m}_std"))]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *stats)
