"""Dataset forensics on record tables (rel, tree, label, split, sha256, ...): duplicates, overlaps, conflicts, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole rounded to nine places, 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 9)


def duplicate_summary(records: DataFrame, key: str = "sha256") -> DataFrame:
    """A1: files, distinct contents, duplicate files and their share. Counts per content are formed first, so one pass shuffles partial counts only."""
    sizes = records.groupBy(key).count()
    out = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("files"), F.count(F.lit(1)).alias("distinct_contents"))
    return out.select("files", "distinct_contents", (F.col("files") - F.col("distinct_contents")).alias("duplicate_files"), share(F.col("files") - F.col("distinct_contents"), F.col("files")).alias("duplicate_share"))


def layout(records: DataFrame) -> DataFrame:
    """A2: counts of each tree by split and by label, two groupings in one pass. The column not grouped by is null; ``by`` names the other."""
    out = records.groupingSets([["tree", "split"], ["tree", "label"]], "tree", "split", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping("split").alias("g"))
    return out.select("tree", F.when(F.col("g") == 0, "split").otherwise("label").alias("by"), F.when(F.col("g") == 0, F.col("split")).otherwise(F.col("label")).alias("value"), "n")


def group_leakage(records: DataFrame, by: str, key: str) -> DataFrame:
    """For each ``by``, contents on either side of the split, those on both, and test files whose content also stands in train."""
    sides = records.groupBy(by, key).agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") == "test").alias("in_test"), F.count_if(F.col("split") == "test").alias("test_files"))
    exposed = F.coalesce(F.sum(F.when(F.col("in_train"), F.col("test_files"))), F.lit(0))
    return sides.groupBy(by).agg(
        F.count_if("in_train").alias("train_unique"),
        F.count_if("in_test").alias("test_unique"),
        F.count_if(F.col("in_train") & F.col("in_test")).alias("crossing"),
        F.sum("test_files").alias("test_files"),
        exposed.alias("exposed"),
        share(exposed, F.sum("test_files")).alias("exposed_share"),
    )


def exposed_rows(records: DataFrame, key: str) -> DataFrame:
    """Test rows whose key also stands in train."""
    return records.where(F.col("split") == "test").join(records.where(F.col("split") == "train").select(key).distinct(), key, "left_semi")


def unexposed_rows(records: DataFrame, key: str) -> DataFrame:
    """Test rows whose key stands nowhere in train."""
    return records.where(F.col("split") == "test").join(records.where(F.col("split") == "train").select(key).distinct(), key, "left_anti")


def overlap(records: DataFrame, by: str, key: str = "sha256") -> DataFrame:
    """For each pair of ``by`` values that share contents, how many, and their share of the smaller one's.

    The values that hold a content are collected into one ordered set, so a content costs pairs of values, never pairs of files.
    """
    held = records.select(by, key).distinct()
    sizes = held.groupBy(by).count()
    sets = held.groupBy(key).agg(F.sort_array(F.collect_set(by)).alias("s")).where(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "left"))
    pairs = left.select("left", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))
    n_left, n_right = (sizes.select(F.col(by).alias(side), F.col("count").alias(f"n_{side}")) for side in ("left", "right"))
    return pairs.join(n_left, "left").join(n_right, "right").select("left", "right", "shared", share(F.col("shared"), F.least("n_left", "n_right")).alias("share_of_smaller"))


def size_histogram(records: DataFrame, key: str = "sha256") -> DataFrame:
    """How many groups there are of each size."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def conflicts(records: DataFrame, label: str, key: str = "sha256", drop_unlabelled: bool = True) -> DataFrame:
    """A4: duplicate groups considered, those with several labels and their files.

    ``drop_unlabelled`` decides whether rows without a label leave before groups are formed, which changes what is considered.
    """
    rows = records.where(F.col(label).isNotNull()) if drop_unlabelled else records
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(label)).alias("labels")).where(F.col("n") > 1)
    bad = F.col("labels") > 1
    return groups.agg(F.count(F.lit(1)).alias("considered"), F.count_if(bad).alias("conflicted"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("conflicted_files"))


def conflicted_members(records: DataFrame, label: str, key: str = "sha256") -> DataFrame:
    """A4: files of conflicted groups by label. Counts by (key, label) come first, so a hot group is a few rows."""
    cells = records.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    bad = cells.groupBy(key).agg(F.count(F.lit(1)).alias("labels")).where(F.col("labels") > 1).select(key)
    return cells.join(bad, key, "left_semi").groupBy(label).agg(F.sum("n").alias("files"))


def conflict_pairs(records: DataFrame, label: str, key: str = "sha256") -> DataFrame:
    """For each pair of labels, the duplicate groups that hold both."""
    sets = records.where(F.col(label).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("s")).where(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "a"))
    return left.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_groups"))


def partitions_2_2_1(labels: DataFrame) -> DataFrame:
    """U16: all splits of five labels into blocks of 2, 2 and 1 as (partition, label, block); ``labels`` has the one column ``label``.

    Equi-joins on a constant enumerate the blocks of a dimension of five rows.
    """
    d = labels.select("label").distinct().withColumn("one", F.lit(1))
    a, b, c, e, g = (d.select("one", F.col("label").alias(x)) for x in "abceg")
    picked = a.join(b, "one").where("a < b").join(c, "one").where("a < c AND c <> b").join(e, "one").where("c < e AND e <> b AND e <> a")
    picked = picked.join(g, "one").where("g NOT IN (a, b, c, e)")
    name = F.concat(F.concat_ws("+", "a", "b"), F.lit("|"), F.concat_ws("+", "c", "e"), F.lit("|"), F.col("g"))
    blocks = F.array(*[F.struct(F.col(x).alias("label"), F.lit(i).alias("block")) for x, i in zip("abceg", (0, 0, 1, 1, 2), strict=True)])
    return picked.select(name.alias("partition"), F.explode(blocks).alias("x")).select("partition", "x.label", "x.block")


def coarsening_conflicts(records: DataFrame, partitions: DataFrame, key: str = "sha256") -> DataFrame:
    """Conflicts of duplicate groups under each partition of the labels, how many the finest labels' conflicts it absorbs, and its rank.

    Labels of a group are a set first, so the sweep joins one row for each (group, label) to a small dimension.
    """
    cells = records.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    sized = cells.groupBy(key).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels")).where(F.col("size") > 1)
    fine = sized.agg(F.count_if(F.col("labels") > 1).alias("fine_conflicts"), F.count(F.lit(1)).alias("considered"))
    mixed = sized.where(F.col("labels") > 1).select(key, "size")
    swept = cells.join(mixed, key).join(F.broadcast(partitions), "label").groupBy("partition", key, "size").agg(F.count_distinct("block").alias("blocks"))
    bad = F.col("blocks") > 1
    rows = swept.groupBy("partition").agg(F.count_if(bad).alias("conflicted"), F.coalesce(F.sum(F.when(bad, F.col("size"))), F.lit(0)).alias("conflicted_files"))
    every = partitions.select("partition").distinct().join(rows, "partition", "left").fillna(0).withColumn("one", F.lit(1)).join(fine.withColumn("one", F.lit(1)), "one")
    return every.select("partition", "considered", "conflicted", "conflicted_files", (F.col("fine_conflicts") - F.col("conflicted")).alias("absorbed"), F.rank().over(W.orderBy("conflicted")).alias("place"))


def stem(path: Column) -> Column:
    """a path without its file suffix and augmentation mark, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"(?i)_aug_[0-9]+$", ""))


def lookup(rows: DataFrame, key: dict[str, Column], *order: str) -> DataFrame:
    """the first row, by ``order``, whose columns equal the key; a null of the key matches nulls."""
    for name, value in key.items():
        rows = rows.where(F.col(name).eqNullSafe(value))
    return rows.orderBy(*order).limit(1)


def sorted_distinct(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a dimension column in order, with their zero-based ``place``."""
    values = rows.select(column).distinct()
    return values.withColumn("place", F.row_number().over(W.orderBy(column)) - 1).orderBy(column)
