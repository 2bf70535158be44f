"""Splits, samples and tests by hash-ordered resampling; md5 gives Spark and SQL the same draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, metrics
from ..operators import resampling as op
from ..operators.records import records
from . import risk, scores
from .audit import RECORDS, five_way
from .catalog import query


def _draw(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 13))::BIGINT"


#: Seeds of the repeated protocols, as many as the reference's default.
SEEDS = 10
_SEEDS = f"seeds AS (SELECT unnest(range({SEEDS})) AS seed)"


def seeds(spark: SparkSession) -> DataFrame:
    return spark.range(SEEDS).withColumnRenamed("id", "seed")


#: A naive split of the rows and a split of leakage groups, for each seed.
PROTOCOLS = f"""{risk.GROUPS}, {_SEEDS}, named AS (SELECT rel, component, sha256 FROM grouped JOIN records ON rel = node),
naive AS (SELECT 'naive' AS protocol, seed, rel, component, sha256, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY {_draw("seed", "rel")}, rel) <= round_even((SELECT count(*) FROM named) * 0.15, 0) THEN 'test' ELSE 'train' END AS role FROM named, seeds),
comps AS (SELECT DISTINCT component FROM named),
gsplit AS (SELECT seed, component, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY {_draw("seed", "component")}, component) <= round_even((SELECT count(*) FROM comps) * 0.15, 0) THEN 'test' ELSE 'train' END AS role FROM comps, seeds),
protocols AS (SELECT * FROM naive UNION ALL SELECT 'group', seed, rel, n.component, sha256, role FROM named n JOIN gsplit USING (component))"""


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long table (protocol, seed, rel, component, sha256, role), which one plan evaluates."""
    rows = risk.groups(spark, sf_dir).join(records(spark, sf_dir).select("rel", "sha256"), "rel")
    naive = op.random_split(rows, "rel", seeds(spark)).withColumn("protocol", F.lit("naive"))
    grouped = op.group_split(rows, "component", seeds(spark)).withColumn("protocol", F.lit("group"))
    return naive.unionByName(grouped).select("protocol", "seed", "rel", "component", "sha256", "role")


@query(f"WITH RECURSIVE {PROTOCOLS} SELECT protocol, seed, role, count(*) AS n, sum(rel)::BIGINT AS rel_sum FROM protocols GROUP BY ALL")
def split_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R2, R4, R5."""
    return protocols(spark, sf_dir).groupBy("protocol", "seed", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").alias("rel_sum"))


@query(f"""WITH RECURSIVE {PROTOCOLS}, tr AS (SELECT DISTINCT protocol, seed, component FROM protocols WHERE role = 'train'), th AS (SELECT DISTINCT protocol, seed, sha256 FROM protocols WHERE role = 'train')
SELECT p.protocol, p.seed, count(*) AS test_files, round(avg((th.sha256 IS NOT NULL)::INT), 9) AS exact_share, round(avg((tr.component IS NOT NULL)::INT), 9) AS group_share
FROM protocols p LEFT JOIN tr ON tr.protocol = p.protocol AND tr.seed = p.seed AND tr.component = p.component LEFT JOIN th ON th.protocol = p.protocol AND th.seed = p.seed AND th.sha256 = p.sha256 WHERE role = 'test' GROUP BY p.protocol, p.seed""")
def protocol_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each protocol's test files with a copy, or a group member, in its train files."""
    p = protocols(spark, sf_dir)
    out = p.where("role = 'test'")
    for key in ("sha256", "component"):
        known = p.where("role = 'train'").select("protocol", "seed", key).distinct().withColumn(f"in_{key}", F.lit(1.0))
        out = out.join(known, ["protocol", "seed", key], "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 9)
    return out.groupBy("protocol", "seed").agg(F.count(F.lit(1)).alias("test_files"), share("in_sha256").alias("exact_share"), share("in_component").alias("group_share"))


@query(f"""WITH {RECORDS} SELECT tree, CASE WHEN row_number() OVER (PARTITION BY tree ORDER BY {_draw("7", "rel")}, rel) <= round_even(count(*) OVER (PARTITION BY tree) * 0.2, 0) THEN 'validation' ELSE 'train' END AS role, rel FROM records""")
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each language held out."""
    return op.quota_split(records(spark, sf_dir), "rel", "tree", seed=7).select("tree", "role", "rel")


@query(f"""WITH {RECORDS}, sizes AS (SELECT tree, count(*) // 2 AS n FROM records GROUP BY tree), r AS (SELECT tree, rel, row_number() OVER (PARTITION BY tree ORDER BY {_draw("3", "rel")}, rel) AS i FROM records)
SELECT tree, rel FROM r JOIN sizes USING (tree) WHERE i <= n""")
def matched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each language's documents."""
    rows = records(spark, sf_dir)
    sizes = rows.groupBy("tree").agg(F.floor(F.count(F.lit(1)) / 2).alias("n"))
    return op.matched_sample(rows.select("tree", "rel"), "rel", "tree", sizes, seed=3)


@query(f"""WITH {RECORDS}, c AS (SELECT tree, count(*) AS n, row_number() OVER (ORDER BY tree) - 1 AS i FROM records GROUP BY tree), d AS (SELECT unnest(range(200)) AS draw),
p AS (SELECT draw, tree, {_draw("'0-row'", "draw")} % n AS place FROM d JOIN c ON c.i = {_draw("'0-class'", "draw")} % (SELECT count(*) FROM c)), r AS (SELECT tree, rel, row_number() OVER (PARTITION BY tree ORDER BY {_draw("0", "rel")}, rel) - 1 AS place FROM records)
SELECT draw, tree, rel FROM p JOIN r USING (tree, place)""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred draws with replacement, languages equally likely."""
    return op.weighted_sample(records(spark, sf_dir).select("tree", "rel"), "rel", "tree", 200)


def _boot_sql(replicates: int) -> str:
    return f"""{scores.NN}, cells AS (SELECT nn_id % 17 AS g, truth, pred, count(*) AS n FROM nn GROUP BY ALL), gs AS (SELECT g, row_number() OVER (ORDER BY {_draw("'0-order'", "g")}, g) - 1 AS place FROM (SELECT DISTINCT g FROM cells)),
picks AS (SELECT replicate, {_draw("'0-draw'", "replicate", "i")} % (SELECT count(*) FROM gs) AS place FROM (SELECT unnest(range({replicates})) AS replicate), (SELECT unnest(range(1, (SELECT count(*) FROM gs) + 1)) AS i)),
b AS (SELECT replicate, truth, pred, sum(n)::BIGINT AS n FROM picks JOIN gs USING (place) JOIN cells USING (g) GROUP BY ALL)"""


def _boot(spark: SparkSession, sf_dir: str, replicates: int) -> DataFrame:
    cells = metrics.confusion(scores.predictions(spark, sf_dir).withColumn("g", F.col("nn_id") % 17), "g")
    return op.bootstrap_counts(cells, "g", replicates)


def _interval_sql(replicates: int) -> str:
    return f"""WITH {_boot_sql(replicates)}, r AS (SELECT replicate, truth, sum(n) FILTER (truth = pred) AS hit, sum(n) AS n FROM b GROUP BY replicate, truth), m AS (SELECT replicate, avg(coalesce(hit, 0) / n) AS v, count(*) AS k FROM r GROUP BY replicate), f AS (SELECT v FROM m WHERE k = (SELECT count(DISTINCT truth) FROM cells))
SELECT count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM f"""


def _interval(spark: SparkSession, sf_dir: str, replicates: int) -> DataFrame:
    b = _boot(spark, sf_dir, replicates)
    recalls = metrics.per_class(b, "replicate").where("support > 0").groupBy("replicate").agg(F.avg("recall").alias("v"), F.count(F.lit(1)).alias("k"))
    classes = scores.predictions(spark, sf_dir).agg(F.count_distinct("truth").alias("classes"))
    full = recalls.join(F.broadcast(classes)).where("k = classes")
    return full.agg(F.count(F.lit(1)).alias("replicates"), F.round(F.percentile("v", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("high"))


#: As many replicates as the reference's default.
REPLICATES = 2_000


@query(_interval_sql(REPLICATES))
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 95 % interval of the balanced accuracy from groups resampled; replicates that miss a class are left out."""
    return _interval(spark, sf_dir, REPLICATES)


def _noise(turn: int, v: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', 1729, replicate, {turn}, {v})), 1, 13))::BIGINT"


#: The network's four rounds in SQL, applied to ``v`` until it is below n: four times are enough for the tables at hand, and a place that were still beyond would show as a wrong count.
_ROUNDS = f"""(SELECT replicate, sha256, n, fa, fb, CASE WHEN v >= n OR NOT begun THEN x2 * fb + (y1 + {_noise(4, "x2")}) % fb ELSE v END AS v, true AS begun FROM (
  SELECT *, (x1 + {_noise(3, "y1")}) % fa AS x2 FROM (SELECT *, (y0 + {_noise(2, "x1")}) % fb AS y1 FROM (SELECT *, (x0 + {_noise(1, "y0")}) % fa AS x1 FROM (SELECT *, v // fb AS x0, v % fb AS y0 FROM begin_)))))"""


def _walks(times: int) -> str:
    inner = "begin_"
    for _ in range(times):
        inner = _ROUNDS.replace("begin_", inner)
    return inner


_NULL = f"""{RECORDS}, five AS (SELECT rel, sha256, substr(label, 4)::INT % 5 AS label FROM records), sized AS (SELECT count(*) AS n, ceil(sqrt(count(*)::DOUBLE))::BIGINT AS fa FROM five),
several AS (SELECT sha256 FROM five GROUP BY sha256 HAVING count(*) > 1),
placed AS (SELECT sha256, row_number() OVER (ORDER BY {_draw("'1729-place'", "rel")}, rel) - 1 AS v FROM five WHERE sha256 IN (SELECT sha256 FROM several)),
begin_ AS (SELECT replicate, sha256, v, n, fa, ceil(n / fa)::BIGINT AS fb, false AS begun FROM placed, sized, (SELECT unnest(range({REPLICATES})) AS replicate)),
walked AS MATERIALIZED (SELECT replicate, sha256, v FROM {_walks(4)}),
upto AS (SELECT label, sum(count(*)) OVER (ORDER BY label) AS upto FROM five GROUP BY label),
dealt AS (SELECT replicate, sha256, (SELECT count(*) FROM upto WHERE v >= upto) AS label FROM walked),
per AS (SELECT replicate, sha256, count(DISTINCT label) AS labels FROM dealt GROUP BY replicate, sha256),
null_ AS (SELECT replicate, count(*) FILTER (labels > 1) AS conflicted FROM per GROUP BY replicate)"""


def _null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.permuted_conflicts(five_way(spark, sf_dir), "rel", "sha256", "label", REPLICATES)


@query(f"WITH {_NULL} SELECT replicate, conflicted FROM null_")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R15, A4."""
    return _null(spark, sf_dir)


@query(f"""WITH {_NULL}, o AS (SELECT count(*) AS observed FROM (SELECT sha256 FROM five GROUP BY sha256 HAVING count(DISTINCT label) > 1))
SELECT any_value(observed) AS observed, count(*) AS replicates, round(avg(conflicted), 9) AS null_mean, min(conflicted) AS null_min, max(conflicted) AS null_max, round(avg((conflicted >= observed)::INT), 9) AS p_high, round(avg((conflicted <= observed)::INT), 9) AS p_low,
  round(1.0::DOUBLE / (count(*) + 1), 9) AS floor, count(*) FILTER (conflicted >= 0.8 * observed AND conflicted <= 1.25 * observed) AS alike FROM null_, o""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R15, R16."""
    observed = audit.conflicts(five_way(spark, sf_dir), "label").select(F.col("conflicted").alias("observed"))
    return op.permutation_summary(_null(spark, sf_dir), observed)
