"""Splits, samples, permutations and bootstraps that depend on keys and seeds alone, never on the order or number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: Column | int | str, *key: str) -> Column:
    """A uniform whole number below 2 ** 52 from a seed and a key."""
    parts = [F.lit(seed) if not isinstance(seed, Column) else seed, *[F.col(k) for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def ranked(rows: DataFrame, order: str, tie: str, *by: str, out: str = "place", parts: int = 64) -> DataFrame:
    """Adds the zero-based place of each row within ``by`` in the order of a ``draw`` column, without a task that holds all of ``by``.

    The draw's leading bits cut its range into ``parts`` even pieces; rows are numbered within their piece, and the counts of the
    pieces before (parts x groups rows) are added.
    """
    piece = F.floor(F.col(order) / (2**52 // parts)).cast("int")
    rows = rows.withColumn("__piece", piece)
    before = W.partitionBy(*by).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    nth = F.row_number().over(W.partitionBy(*by, "__piece").orderBy(order, tie))
    return rows.withColumn("__nth", nth).join(starts, [*by, "__piece"]).withColumn(out, F.col("__start") + F.col("__nth") - 1).drop("__piece", "__nth", "__start")


def random_split(rows: DataFrame, key: str, seeds: DataFrame, share: float = 0.15) -> DataFrame:
    """For each seed the first round(share * n) rows in a random order are test: adds ``seed`` and ``role``. Half rounds to even."""
    every = rows.withColumn("one", F.lit(1)).join(F.broadcast(seeds.select("seed").withColumn("one", F.lit(1))), "one").drop("one")
    size = rows.agg(F.bround(F.count(F.lit(1)) * share).cast("long"))
    placed = ranked(every.withColumn("__draw", draw(F.col("seed"), key)), "__draw", key, "seed", out="__place")
    return placed.withColumn("role", F.when(F.col("__place") < size.scalar(), "test").otherwise("train")).drop("__draw", "__place")


def held_slice(rows: DataFrame, key: str, by: str, share: float, least: int, seed: int | str) -> DataFrame:
    """Adds ``held`` to each group's first max(least, round(share * n)) rows in a random order."""
    sizes = rows.groupBy(by).agg(F.greatest(F.lit(least).cast("long"), F.bround(F.count(F.lit(1)) * share).cast("long")).alias("__quota"))
    placed = ranked(rows.withColumn("__draw", draw(seed, by, key) if by != "__all" else draw(seed, key)), "__draw", key, by, out="__place")
    return placed.join(sizes, by).withColumn("held", F.col("__place") < F.col("__quota")).drop("__draw", "__place", "__quota")


def drawn_sample(rows: DataFrame, key: str, by: str, sizes: DataFrame, seeds: DataFrame, name: str) -> DataFrame:
    """R11 for many seeds at once: (seed, key) of as many random rows of each class as ``sizes`` (by, n) asks for, or as there are."""
    every = rows.select(key, by).withColumn("seed", F.explode(F.lit(seeds.agg(F.collect_list("seed")).scalar())))
    placed = ranked(every.withColumn("__draw", draw(name, "seed", key)), "__draw", key, "seed", by, out="__place")
    return placed.join(sizes, by).where(F.col("__place") < F.col("n")).select("seed", key)


def group_split(rows: DataFrame, group: str, seeds: DataFrame, share: float = 0.15) -> DataFrame:
    """R2: like ``random_split`` over groups instead of rows, so no group stands on both sides; the share of rows varies."""
    parts = random_split(rows.select(group).distinct(), group, seeds, share)
    return rows.join(parts, group)


def quota_split(rows: DataFrame, key: str, by: str, seed: int = 0, share: float = 0.2) -> DataFrame:
    """round(share * n) random rows of each class are held out: adds ``role``."""
    sizes = rows.groupBy(by).agg(F.bround(F.count(F.lit(1)) * share).cast("long").alias("__quota"))
    placed = ranked(rows.withColumn("__draw", draw(seed, key)), "__draw", key, by, out="__place")
    return placed.join(sizes, by).withColumn("role", F.when(F.col("__place") < F.col("__quota"), "validation").otherwise("train")).drop("__draw", "__place", "__quota")


def matched_sample(rows: DataFrame, key: str, by: str, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """As many random rows of each class as ``sizes`` (by, n) asks for; a class with too few raises when the rows are read."""
    pools = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__pool"))
    enough = sizes.join(pools, by, "left").select(by, F.when(F.coalesce("__pool", F.lit(0)) >= F.col("n"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("too few rows of "), F.col(by).cast("string")))).alias("__n"))
    placed = ranked(rows.withColumn("__draw", draw(seed, key)), "__draw", key, by, out="__place")
    return placed.join(enough, by).where(F.col("__place") < F.col("__n")).drop("__draw", "__place", "__n")


def weighted_sample(rows: DataFrame, key: str, by: str, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` rows with replacement, each class equally likely: (draw, class, key).

    Each draw picks a class and a place in it by hash; places are an equi-join.
    """
    classes = rows.select(by).distinct().withColumn("__c", F.row_number().over(W.orderBy(by)) - 1)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).join(classes, by)
    total = classes.agg(F.count(F.lit(1)).alias("__k"))
    picks = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(total))
    picks = picks.withColumn("__c", draw(f"{seed}-class", "draw") % F.col("__k")).join(F.broadcast(sizes), "__c").withColumn("__place", draw(f"{seed}-row", "draw") % F.col("__n"))
    placed = ranked(rows.withColumn("__draw", draw(seed, key)), "__draw", key, by, out="__place")
    return picks.join(placed.select(by, key, "__place"), [by, "__place"]).select("draw", by, key)


def bootstrap_counts(cells: DataFrame, group: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, truth, pred, n): groups of (group, truth, pred, n) resampled with replacement.

    Metrics need only the cells' sums, so rows are aggregated by group once, and each replicate draws groups, never rows.
    """
    spark = cells.sparkSession
    groups = ranked(cells.select(group).distinct().withColumn("__draw", draw(f"{seed}-order", group)).withColumn("__all", F.lit(0)), "__draw", group, "__all", out="__place").select(group, "__place")
    n = groups.agg(F.count(F.lit(1)).alias("__n"))
    reps = spark.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(n))
    picks = reps.select("replicate", "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i")).withColumn("__place", draw(f"{seed}-draw", "replicate", "__i") % F.col("__n"))
    times = picks.groupBy("replicate", "__place").agg(F.count(F.lit(1)).alias("__times"))
    return times.join(groups, "__place").join(cells, group).groupBy("replicate", "truth", "pred").agg(F.sum(F.col("n") * F.col("__times")).alias("n"))


def permuted(place: Column, replicate: Column, size: Column, seed: int) -> Column:
    """A place below ``size``, permuted by a keyed network of its own for each replicate: no two places of a replicate meet, and nothing is sorted.

    Four rounds over two factors, whose product is at least ``size`` and over it by less than the first; what lands beyond is sent on, as often as it takes.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")
    noise = lambda i, v: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), replicate.cast("string"), i.cast("string"), v.cast("string"))), 1, 13), 16, 10).cast("long")

    def network(v: Column) -> Column:
        def turn(acc: Column, i: Column) -> Column:
            x, y = acc["x"], acc["y"]
            odd = i % 2 == 1
            return F.struct(F.when(odd, (x + noise(i, y)) % a).otherwise(x).alias("x"), F.when(odd, y).otherwise((y + noise(i, x)) % b).alias("y"))

        start = F.struct(F.floor(v / b).cast("long").alias("x"), (v % b).alias("y"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, lambda acc: acc["x"] * b + acc["y"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(-1).cast("long"), lambda v, i: F.when((i == 1) | (v >= size), network(F.when(i == 1, place).otherwise(v))).otherwise(v))
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("a permutation did not end")))


#: Parts that the replicates of a permutation null are dealt out in.
DEALT = 64


def permuted_conflicts(rows: DataFrame, key: str, group: str, label: str, replicates: int, seed: int = 1729) -> DataFrame:
    """(replicate, conflicted): duplicate groups with several labels after labels are dealt to rows at random, without replacement.

    Rows of groups of one can't conflict, so that only the others are dealt labels: each has a place of its own, which a keyed
    permutation of each replicate sends into all labels in their order, where the classes' counts tell the label. Rows aren't
    sorted within replicates, and only (replicate, group) sums are shuffled.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("classes"), F.sum("n").alias("total"))  # labels are a dimension
    several = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(group)
    some = rows.select(key, group).join(several, group, "left_semi").withColumn("__draw", draw(f"{seed}-place", key)).withColumn("__all", F.lit(0))
    placed = ranked(some, "__draw", key, "__all").select(group, "place").withColumns({c: packed.select(c).scalar() for c in ("classes", "total")})
    # the rows are few beside the replicates, so that these are dealt out first
    dealt = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(DEALT, replicates) - 1).cast("long")))).repartition(DEALT, "part")
    every = dealt.withColumn("replicate", F.explode(F.sequence(F.col("part"), F.lit(replicates - 1).cast("long"), F.lit(DEALT).cast("long"))))
    at = every.withColumn("a", F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long")).withColumn("b", F.ceil(F.col("total") / F.col("a")).cast("long")).withColumn("at", F.col("place"))
    noise = lambda turn, v: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.lit(str(turn)), F.col(v).cast("string"))), 1, 13), 16, 10).cast("long")
    for walk in range(3):  # the network of ``permuted`` as plain columns; what is still beyond after three times goes through it itself
        at = at.withColumn("x", F.floor(F.col("at") / F.col("b")).cast("long")).withColumn("y", F.col("at") % F.col("b"))
        for turn, (v, w, most) in enumerate((("x", "y", "a"), ("y", "x", "b"), ("x", "y", "a"), ("y", "x", "b")), 1):
            at = at.withColumn(v, (F.col(v) + noise(turn, w)) % F.col(most))
        landed = F.col("x") * F.col("b") + F.col("y")
        at = at.withColumn("at", landed if not walk else F.when(F.col("at") < F.col("total"), F.col("at")).otherwise(landed))
    at = at.withColumn("at", F.when(F.col("at") < F.col("total"), F.col("at")).otherwise(permuted(F.col("place"), F.col("replicate"), F.col("total"), seed))).select("replicate", group, "classes", "at")
    place_of = F.aggregate("classes", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("nth")), lambda acc, c: F.struct((acc["upto"] + c["n"]).alias("upto"), (acc["nth"] + F.when(F.col("at") >= acc["upto"] + c["n"], 1).otherwise(0)).alias("nth")))["nth"]
    per = at.select("replicate", group, place_of.alias("dealt")).groupBy("replicate", group).agg((F.min("dealt") != F.max("dealt")).alias("several"))
    return per.groupBy("replicate").agg(F.count_if("several").alias("conflicted"))


def permutation_summary(null: DataFrame, observed: DataFrame) -> DataFrame:
    """The observed count (column ``observed``) against its null: mean, least, greatest, share at or above and at or below, the floor
    1 / (B + 1), and how many replicates lie within 0.8 and 1.25 of it."""
    o = F.first("observed")
    return null.join(F.broadcast(observed)).agg(
        o.alias("observed"),
        F.count(F.lit(1)).alias("replicates"),
        F.round(F.avg("conflicted"), 9).alias("null_mean"),
        F.min("conflicted").alias("null_min"),
        F.max("conflicted").alias("null_max"),
        F.round(F.avg((F.col("conflicted") >= F.col("observed")).cast("double")), 9).alias("p_high"),
        F.round(F.avg((F.col("conflicted") <= F.col("observed")).cast("double")), 9).alias("p_low"),
        F.round(1.0 / (F.count(F.lit(1)) + 1), 9).alias("floor"),
        F.count_if((F.col("conflicted") >= 0.8 * F.col("observed")) & (F.col("conflicted") <= 1.25 * F.col("observed"))).alias("alike"),
    )
