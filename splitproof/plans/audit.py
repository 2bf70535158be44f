"""Dataset forensics over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as op
from ..operators.records import records
from .catalog import query

#: The record table in SQL, as operators.records makes it.
RECORDS = """records AS (
  SELECT doc_id AS rel, lang AS tree, source AS label, CASE WHEN (doc_id * 2654435761) % 100 < 15 THEN 'test' ELSE 'train' END AS split, sha256(text) AS sha256 FROM documents
)"""
#: Five-way labels: the number in a source's name modulo 5.
FIVE = f"{RECORDS}, five AS (SELECT rel, sha256, substr(label, 4)::INT % 5 AS label FROM records)"


def five_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("label", F.substring("label", 4, 9).cast("int") % 5)


@query(f"""WITH {RECORDS}, sides AS (
  SELECT tree, sha256, bool_or(split = 'train') AS in_train, bool_or(split = 'test') AS in_test, count(*) FILTER (split = 'test') AS test_files FROM records GROUP BY tree, sha256
)
SELECT tree, count(*) FILTER (in_train)::BIGINT AS train_unique, count(*) FILTER (in_test)::BIGINT AS test_unique, count(*) FILTER (in_train AND in_test)::BIGINT AS crossing,
  sum(test_files)::BIGINT AS test_files, coalesce(sum(test_files) FILTER (in_train), 0)::BIGINT AS exposed, round(coalesce(coalesce(sum(test_files) FILTER (in_train), 0) / nullif(sum(test_files), 0), 0), 9)::DOUBLE AS exposed_share
FROM sides GROUP BY tree""")
def hard_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tree, test files whose bytes also stand in train."""
    return op.group_leakage(records(spark, sf_dir), "tree", "sha256")


@query(f"WITH {RECORDS} SELECT count(*) AS files, count(DISTINCT sha256) AS distinct_contents, count(*) - count(DISTINCT sha256) AS duplicate_files, round((count(*) - count(DISTINCT sha256)) / count(*), 9)::DOUBLE AS duplicate_share FROM records")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.duplicate_summary(records(spark, sf_dir))


@query(f"""WITH {RECORDS}
SELECT tree, 'split' AS "by", split AS value, count(*) AS n FROM records GROUP BY tree, split
UNION ALL SELECT tree, 'label', label, count(*) FROM records GROUP BY tree, label""")
def tree_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.layout(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, held AS (SELECT DISTINCT label, sha256 FROM records), sizes AS (SELECT label, count(*) AS n FROM held GROUP BY label)
SELECT a.label AS "left", b.label AS "right", count(*) AS shared, round(count(*) / least(any_value(x.n), any_value(y.n)), 9)::DOUBLE AS share_of_smaller
FROM held a JOIN held b ON a.sha256 = b.sha256 AND a.label < b.label JOIN sizes x ON x.label = a.label JOIN sizes y ON y.label = b.label GROUP BY a.label, b.label""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that two sources share."""
    return op.overlap(records(spark, sf_dir), "label")


@query(f"WITH {RECORDS}, g AS (SELECT sha256, count(*) AS size FROM records GROUP BY sha256) SELECT size, count(*) AS n_groups FROM g GROUP BY size")
def duplicate_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.size_histogram(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, g AS (SELECT sha256, count(*) AS n, count(DISTINCT label) AS k FROM records WHERE label IS NOT NULL GROUP BY sha256 HAVING count(*) > 1)
SELECT count(*) AS considered, count(*) FILTER (k > 1) AS conflicted, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS conflicted_files FROM g""")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conflicts(records(spark, sf_dir), "label")


#: Three zones, and no zone for two of the five labels: dropping those rows first or last are different questions.
ZONED = f"{FIVE}, zoned AS (SELECT rel, sha256, CASE WHEN label < 3 THEN label END AS zone FROM five)"


@query(f"""WITH {ZONED}, a AS (SELECT sha256, count(*) AS n, count(DISTINCT zone) AS k FROM zoned WHERE zone IS NOT NULL GROUP BY sha256 HAVING count(*) > 1),
b AS (SELECT sha256, count(*) AS n, count(DISTINCT zone) AS k FROM zoned GROUP BY sha256 HAVING count(*) > 1)
SELECT 'before' AS dropped, count(*) AS considered, count(*) FILTER (k > 1) AS conflicted, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS conflicted_files FROM a
UNION ALL SELECT 'after', count(*), count(*) FILTER (k > 1), coalesce(sum(n) FILTER (k > 1), 0)::BIGINT FROM b""")
def zone_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of zones, with unmapped rows dropped before grouping and after it."""
    zoned = five_way(spark, sf_dir).withColumn("zone", F.when(F.col("label") < 3, F.col("label")))
    first, last = (op.conflicts(zoned, "zone", drop_unlabelled=d).select(F.lit(n).alias("dropped"), "*") for n, d in (("before", True), ("after", False)))
    return first.unionByName(last)


@query(f"""WITH {RECORDS}, bad AS (SELECT sha256 FROM records GROUP BY sha256 HAVING count(DISTINCT label) > 1)
SELECT label, count(*) AS files FROM records WHERE sha256 IN (SELECT sha256 FROM bad) GROUP BY label""")
def conflicted_files_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conflicted_members(records(spark, sf_dir), "label")


@query(f"""WITH {RECORDS}, held AS (SELECT DISTINCT label, sha256 FROM records)
SELECT a.label AS a, b.label AS b, count(*) AS n_groups FROM held a JOIN held b ON a.sha256 = b.sha256 AND a.label < b.label GROUP BY a.label, b.label""")
def conflict_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conflict_pairs(records(spark, sf_dir), "label")


PARTITIONS = """d AS (SELECT unnest(range(5))::INT AS label), picked AS (
  SELECT a.label AS a, b.label AS b, c.label AS c, e.label AS e, g.label AS g FROM d a, d b, d c, d e, d g
  WHERE a.label < b.label AND a.label < c.label AND c.label < e.label AND len(list_distinct([a.label, b.label, c.label, e.label, g.label])) = 5
), partitions AS (
  SELECT a || '+' || b || '|' || c || '+' || e || '|' || g AS partition, unnest([a, b, c, e, g]) AS label, unnest([0, 0, 1, 1, 2]) AS block FROM picked
)"""


def _partitions(spark: SparkSession) -> DataFrame:
    return op.partitions_2_2_1(spark.range(5).select(F.col("id").cast("int").alias("label")))


@query(f"WITH {PARTITIONS} SELECT partition, label, block FROM partitions")
def label_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16: the fifteen ways to put five labels into blocks of 2, 2 and 1."""
    return _partitions(spark)


@query(f"""WITH {FIVE}, {PARTITIONS}, sized AS (SELECT sha256, count(*) AS size, count(DISTINCT label) AS labels FROM five GROUP BY sha256 HAVING count(*) > 1),
swept AS (SELECT partition, f.sha256, count(*) AS size, count(DISTINCT block) AS blocks FROM five f JOIN sized USING (sha256) JOIN partitions p ON p.label = f.label GROUP BY partition, f.sha256),
rows AS (SELECT partition, count(*) AS considered, count(*) FILTER (blocks > 1) AS conflicted, coalesce(sum(size) FILTER (blocks > 1), 0)::BIGINT AS conflicted_files FROM swept GROUP BY partition)
SELECT *, (SELECT count(*) FILTER (labels > 1) FROM sized) - conflicted AS absorbed, rank() OVER (ORDER BY conflicted)::INT AS place FROM rows""")
def coarsening_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.coarsening_conflicts(five_way(spark, sf_dir), _partitions(spark))


@query(f"""WITH {RECORDS} SELECT tree, count(*) AS n FROM records r WHERE split = 'test' AND EXISTS (SELECT 1 FROM records t WHERE t.split = 'train' AND t.sha256 = r.sha256) GROUP BY tree""")
def exposed_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exposed_rows(records(spark, sf_dir), "sha256").groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS} SELECT tree, count(*) AS n FROM records r WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM records t WHERE t.split = 'train' AND t.sha256 = r.sha256) GROUP BY tree""")
def unexposed_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unexposed_rows(records(spark, sf_dir), "sha256").groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH f AS (SELECT regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/[0-9]+$', '') AS family, count(*) AS size FROM pages GROUP BY 1)
SELECT count(*) AS families, count(*) FILTER (size > 1) AS repeated, max(size) AS largest, sum(size)::BIGINT AS pages FROM f""")
def page_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose addresses differ in query, fragment or number alone."""
    family = F.regexp_replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "/[0-9]+$", "")
    sizes = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("families"), F.count_if(F.col("size") > 1).alias("repeated"), F.max("size").alias("largest"), F.sum("size").alias("pages"))


@query(r"""SELECT lower(regexp_extract(split_part(url, '?', 1), '^(https?)://', 1)) AS scheme, split_part(split_part(url, '?', 1), '/', 3) AS host, coalesce(CASE WHEN split_part(split_part(url, '?', 1), '/', 4) IN ('en', 'fr', 'de', 'es') THEN split_part(split_part(url, '?', 1), '/', 4) END, 'unsplit') AS part, substr(sha256(url), 1, 20) AS sample_id, page_id FROM pages""")
def page_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts of an address; the first part that is a known name, or ``unsplit``; an id from the address's hash."""
    bare = F.substring_index("url", "?", 1)
    parts = F.split(bare, "/")
    known = F.when(F.get(parts, F.lit(3)).isin("en", "fr", "de", "es"), F.get(parts, F.lit(3)))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lower(F.regexp_extract(bare, "^(https?)://", 1)).alias("scheme"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("host"), F.coalesce(known, F.lit("unsplit")).alias("part"), F.substring(F.sha2("url", 256), 1, 20).alias("sample_id"), "page_id")


_HAZARDS = {"mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "secret": r"(password|token) *= *", "long_number": r"(^|[^0-9])[0-9]{13,19}([^0-9]|$)", "rights": r"[Rr]ights reserved"}


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in _HAZARDS.items()) + r", sum(length(regexp_replace(trim(text, ' ' || chr(10)), '[ \n\t]+', ' ', 'g')))::BIGINT AS chars_normalised FROM documents GROUP BY lang")
def text_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts that hold what should not be released, and their length with white space normalised."""
    counts = [F.count_if(F.col("text").rlike(p)).alias(n) for n, p in _HAZARDS.items()]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(*counts, F.sum(F.char_length(F.regexp_replace(F.btrim("text", F.lit(" \n")), "[ \n\t]+", " "))).alias("chars_normalised"))
