"""Evaluation protocols over documents with vectors: who is train and who is test, what leaks, and what predictions are worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, heads, metrics
from ..operators import resampling as op
from ..operators.neighbours import distinct_bits, hamming_pairs, median_bits, nearest, perceptual_bits
from ..operators.records import records
from ..session import scratch, written
from . import risk
from .catalog import query
from .resampling import SEEDS, _draw

#: Near copies of vectors: every sixth vector stands for its predecessor with two coefficients negated.
_TURNED = "id % 6 = 1"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bits): the 64-bit hashes of vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    ids = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 6 == 1, F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("of"))
    turned = F.transform("embedding", lambda x, i: F.when((i == F.col("id") % 63 + 1) | (i == F.col("id") * 7 % 63 + 1), -x).otherwise(x))
    vector = F.when(F.col("id") % 6 == 1, turned).otherwise(F.col("embedding"))
    return ids.join(e, F.col("of") == F.col("vec_id")).select("id", median_bits(vector).alias("bits"))


#: Leakage groups as ``risk.GROUPS`` has them, with edges between near hashes as well.
NEAR = f"""{risk.GROUPS.split("), linked AS")[0]}
), pts AS (
  SELECT t.vec_id AS id, CASE WHEN t.vec_id % 6 = 1 THEN list_transform(list_zip(s.embedding, range(64)), lambda p: CASE WHEN p[2] IN (t.vec_id % 63 + 1, t.vec_id * 7 % 63 + 1) THEN -p[1] ELSE p[1] END) ELSE s.embedding END AS v
  FROM embeddings t JOIN embeddings s ON s.vec_id = CASE WHEN t.vec_id % 6 = 1 THEN t.vec_id - 1 ELSE t.vec_id END
), bits AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x > m) AS b FROM (SELECT id, v, list_aggregate(v[2:], 'median') AS m FROM pts)
), near AS MATERIALIZED (SELECT b.id AS src, a.id AS dst FROM bits a JOIN bits b ON a.id < b.id WHERE list_sum(list_transform(list_zip(a.b, b.b), lambda p: (p[1] <> p[2])::INT)) <= 4
), linked AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges UNION SELECT src, dst FROM near UNION SELECT dst, src FROM near
), reach(node, root) AS (SELECT rel, rel FROM records UNION SELECT b.dst, r.root FROM reach r JOIN linked b ON b.src = r.node
), grouped AS (SELECT node, min(root) AS component FROM reach WHERE node IN (SELECT rel FROM records) GROUP BY node)"""


def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.keyed(spark, sf_dir)
    known = points(spark, sf_dir).join(rows.select(F.col("rel").alias("id")), "id")
    edges = hamming_pairs(distinct_bits(known)).select(F.col("b").alias("src"), F.col("a").alias("dst"))
    keyed = rows.join(known.withColumnRenamed("id", "rel"), "rel", "left")
    return graph.leakage_groups(keyed, "rel", ["sha256", "family", "bits"], edges)


@query(f"WITH RECURSIVE {NEAR} SELECT node AS rel, component FROM grouped")
def near_leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups over equal bytes, families and near hashes; rows that share nothing are their own."""
    return near_groups(spark, sf_dir)


#: Documents with a vector and a zone, and who is in which set of which protocol. Trees are the languages in order.
RUNS = f"""{NEAR}, zoned AS (
  SELECT rel, tree, split, sha256, component, label::BIGINT AS six, (label // 2)::BIGINT AS zone, embedding AS v FROM (SELECT r.* EXCLUDE (label) FROM records r) r JOIN grouped g ON g.node = r.rel JOIN embeddings e ON e.vec_id = r.rel WHERE e.label < 6
), trees AS (SELECT min(tree) AS a, min(tree) FILTER (tree > (SELECT min(tree) FROM records)) AS b FROM records
), seeds AS (SELECT unnest(range({SEEDS})) AS seed
), comps AS (SELECT DISTINCT component FROM zoned
), naive AS (SELECT seed, rel, row_number() OVER (PARTITION BY seed ORDER BY {_draw("seed", "rel")}, rel) <= round_even((SELECT count(*) FROM zoned) * 0.15, 0) AS test FROM zoned, seeds
), gsplit AS (SELECT seed, component, row_number() OVER (PARTITION BY seed ORDER BY {_draw("seed", "component")}, component) <= round_even((SELECT count(*) FROM comps) * 0.15, 0) AS test FROM comps, seeds
), runs AS MATERIALIZED (
  SELECT 'vendor_a' AS protocol, 0 AS seed, rel, split AS role FROM zoned, trees WHERE tree = a
  UNION ALL SELECT 'vendor_b', 0, rel, split FROM zoned, trees WHERE tree = b
  UNION ALL SELECT 'cross_tree', 0, rel, CASE WHEN tree = a THEN 'train' ELSE 'test' END FROM zoned, trees WHERE tree = a OR tree = b AND split = 'test'
  UNION ALL SELECT 'naive', seed, rel, CASE WHEN test THEN 'test' ELSE 'train' END FROM naive
  UNION ALL SELECT 'group', seed, rel, CASE WHEN test THEN 'test' ELSE 'train' END FROM gsplit JOIN zoned USING (component)
)"""


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their group, vector and both labels; rows without a zone are in neither label space."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 6").select(F.col("vec_id").alias("rel"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("six"), F.floor(F.col("label") / 2).alias("zone"))
    rows = records(spark, sf_dir).drop("label").join(near_groups(spark, sf_dir), "rel")
    return written(rows.join(vectors, "rel"), "zoned")


def first_trees(spark: SparkSession, sf_dir: str) -> list[str]:
    """The first two trees in order; trees are a dimension."""
    found = records(spark, sf_dir).select("tree").distinct().orderBy("tree").limit(2).collect()
    return [r.tree for r in found]


def registry(rows: DataFrame, trees: list[str], seeds: int = SEEDS) -> DataFrame:
    """(protocol, seed, rel, role) of the vendors' own splits, across trees, and of naive and group-aware splits for each seed."""
    a, b = (F.col("tree") == t for t in trees)
    test = F.col("split") == "test"
    every = rows.sparkSession.range(seeds).withColumnRenamed("id", "seed")
    once = lambda name, part, role: part.select(F.lit(name).alias("protocol"), F.lit(0).cast("long").alias("seed"), "rel", role.alias("role"))
    many = lambda name, part: part.select(F.lit(name).alias("protocol"), "seed", "rel", "role")
    parts = [
        once("vendor_a", rows.where(a), F.col("split")),
        once("vendor_b", rows.where(b), F.col("split")),
        once("cross_tree", rows.where(a | b & test), F.when(a, "train").otherwise("test")),
        many("naive", op.random_split(rows.select("rel"), "rel", every)),
        many("group", op.group_split(rows.select("rel", "component"), "component", every)),
    ]
    return reduce(DataFrame.unionByName, parts)


_SIDES = """sides AS (SELECT protocol, seed, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM runs GROUP BY ALL
), known AS (SELECT DISTINCT protocol, seed, sha256 FROM runs JOIN zoned USING (rel) WHERE role = 'train'
), kin AS (SELECT DISTINCT protocol, seed, component FROM runs JOIN zoned USING (rel) WHERE role = 'train'
), leaks AS (SELECT r.protocol, r.seed, avg((k.sha256 IS NOT NULL)::INT) AS exact, avg((c.component IS NOT NULL)::INT) AS grp FROM runs r JOIN zoned z USING (rel)
  LEFT JOIN known k ON k.protocol = r.protocol AND k.seed = r.seed AND k.sha256 = z.sha256 LEFT JOIN kin c ON c.protocol = r.protocol AND c.seed = r.seed AND c.component = z.component WHERE role = 'test' GROUP BY ALL)"""


def leak_shares(roles: DataFrame, rows: DataFrame) -> DataFrame:
    """(protocol, seed, n_train, n_test, exact_share, group_share): test rows with a copy, or a group member, in train."""
    known = roles.join(rows.select("rel", "sha256", "component"), "rel")
    out = known.where("role = 'test'")
    for key in ("sha256", "component"):
        train = known.where("role = 'train'").select("protocol", "seed", key).distinct().withColumn(f"in_{key}", F.lit(1.0))
        out = out.join(train, ["protocol", "seed", key], "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 9)
    shares = out.groupBy("protocol", "seed").agg(F.count(F.lit(1)).alias("n_test"), share("in_sha256").alias("exact_share"), share("in_component").alias("group_share"))
    sizes = known.where("role = 'train'").groupBy("protocol", "seed").agg(F.count(F.lit(1)).alias("n_train"))
    return shares.join(sizes, ["protocol", "seed"]).select("protocol", "seed", "n_train", "n_test", "exact_share", "group_share")


@query(f"WITH RECURSIVE {RUNS}, {_SIDES} SELECT protocol, seed, n_train, n_test, round(exact, 9) AS exact_share, round(grp, 9) AS group_share FROM sides JOIN leaks USING (protocol, seed)")
def protocol_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaks in each protocol and seed."""
    rows = zoned(spark, sf_dir)
    return leak_shares(registry(rows, first_trees(spark, sf_dir)), rows)


def predicted(roles: DataFrame, rows: DataFrame, *run: str) -> DataFrame:
    """(run columns, rel, nn): for each test row of each run its nearest train row, all runs in one pass. Runs are counted by parameters, not rows."""
    names = roles.select(*run).distinct().orderBy(*run).collect()
    numbered = F.broadcast(roles.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(names)], roles.select(*run).schema.add("run", "integer")))
    bits = roles.join(numbered, [*run]).groupBy("rel", "role").agg(F.sum(F.expr("shiftleft(1L, run)")).alias("runs"))
    vectors = rows.select(F.col("rel").alias("id"), "vector")
    side = lambda role: vectors.join(bits.where(F.col("role") == role).select(F.col("rel").alias("id"), "runs"), "id")
    found = nearest(side("train").withColumn("label", F.lit(0)), side("test"), len(names))
    return found.join(numbered, "run").select(*run, F.col("id").alias("rel"), F.col("nn_id").alias("nn"))


def _nn(by: str) -> str:
    return f"""nn AS MATERIALIZED (SELECT * EXCLUDE (i) FROM (SELECT {by}, t.rel, b.rel AS nn, z.six AS six, y.six AS six_pred, z.zone AS zone, y.zone AS zone_pred,
  row_number() OVER (PARTITION BY {by}, t.rel ORDER BY list_sum(list_transform(list_zip(z.v, y.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), b.rel) AS i
  FROM runs t JOIN runs b USING ({by}) JOIN zoned z ON z.rel = t.rel JOIN zoned y ON y.rel = b.rel WHERE t.role = 'test' AND b.role = 'train') WHERE i = 1
), calls AS (SELECT {by}, 'six' AS space, six AS truth, six_pred AS pred FROM nn UNION ALL SELECT {by}, 'zone', zone, zone_pred FROM nn)"""


def _scores(by: str, cells: str = "SELECT {by}, truth, pred, count(*) AS n FROM calls GROUP BY ALL") -> str:
    return f"""cells AS ({cells.format(by=by)}
), u AS (SELECT {by}, truth AS class, n AS support, 0 AS predicted, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM cells UNION ALL SELECT {by}, pred, 0, n, 0 FROM cells
), k AS (SELECT {by}, class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM u GROUP BY ALL
), c AS (SELECT *, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM k
), s AS (SELECT {by}, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS acc, avg(recall) FILTER (support > 0) AS bal, avg(f1) AS f1, sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS e FROM c GROUP BY ALL
), summary AS (SELECT {by}, n, round(acc, 9) AS accuracy, round(bal, 9) AS balanced_accuracy, round(f1, 9) AS macro_f1, round(CASE WHEN e < 1 THEN (acc - e) / (1 - e) ELSE 0 END, 9) AS kappa FROM s)"""


_OVER = ", ".join(f"round(avg({m}), 7) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 7) AS {m}_std" for m in ("accuracy", "balanced_accuracy", "macro_f1", "kappa"))


def calls(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(…, space, truth, pred) in both label spaces, over the same rows."""
    truth, pred = (rows.select(F.col("rel").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in ("six", "zone")]) for key in ("rel", "nn"))
    both = found.join(truth, "rel").join(pred, "nn")
    spaces = F.array(*[F.struct(F.lit(c).alias("space"), F.col(f"{c}_rel").alias("truth"), F.col(f"{c}_nn").alias("pred")) for c in ("six", "zone")])
    return both.select("*", F.explode(spaces).alias("x")).select(*[c for c in found.columns if c not in ("rel", "nn")], "x.*")


@query(f"""WITH RECURSIVE {RUNS}, {_SIDES}, {_nn("protocol, seed")}, {_scores("protocol, seed, space")}
SELECT space, protocol, count(*) AS runs, {_OVER}, round(avg(n_test), 6) AS n_test, round(avg(n_train), 6) AS n_train, round(avg(exact), 6) AS exact_share, round(avg(grp), 6) AS group_share FROM summary JOIN sides USING (protocol, seed) JOIN leaks USING (protocol, seed) GROUP BY space, protocol""")
def protocol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak shares and the scores of the nearest neighbour for each protocol, over its seeds, in two label spaces."""
    rows = zoned(spark, sf_dir)
    roles = written(registry(rows, first_trees(spark, sf_dir)), "roles")
    cells = metrics.confusion(calls(predicted(roles, rows, "protocol", "seed"), rows), "protocol", "seed", "space")
    scored = metrics.summary(cells, "protocol", "seed", "space").drop("n").join(leak_shares(roles, rows), ["protocol", "seed"])
    sizes = scored.groupBy("space", "protocol").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("n_test", "n_train", "exact_share", "group_share")])
    return metrics.over_runs(scored, "space", "protocol").join(sizes, ["space", "protocol"])


#: Arms: the first tree's train rows; the second's, whole, or as many of each class as the first has (or as there are). Targets: both trees' test rows.
ARMS = f"""{RUNS.split(", seeds AS")[0].rstrip()}, pool AS (SELECT z.*, tree = a AS own FROM zoned z, trees WHERE tree IN (a, b)
), quota AS (SELECT zone, count(*) FILTER (own) AS n FROM pool WHERE split = 'train' GROUP BY zone
), drawn AS (SELECT seed, rel FROM (SELECT seed, rel, zone, row_number() OVER (PARTITION BY seed, zone ORDER BY {_draw("'arm'", "seed", "rel")}, rel) AS i FROM pool, (SELECT unnest(range({SEEDS})) AS seed) WHERE NOT own AND split = 'train') JOIN quota USING (zone) WHERE i <= n
), arms AS (SELECT 'a_trained' AS arm, 0 AS seed, rel FROM pool WHERE own AND split = 'train' UNION ALL SELECT 'b_trained_full', 0, rel FROM pool WHERE NOT own AND split = 'train' UNION ALL SELECT 'b_trained_matched', seed, rel FROM drawn
), cases AS (SELECT DISTINCT arm, seed FROM arms
), runs AS MATERIALIZED (SELECT arm, seed, rel, 'train' AS role FROM arms UNION ALL SELECT arm, seed, rel, 'test' FROM cases, pool WHERE split = 'test')"""


@query(f"""WITH RECURSIVE {ARMS}, {_nn("arm, seed")}, aimed AS (SELECT arm, seed, own, zone AS truth, zone_pred AS pred FROM nn JOIN (SELECT rel, CASE WHEN own THEN 'a_test' ELSE 'b_test' END AS own FROM pool) USING (rel)
), {_scores("arm, seed, target", "SELECT arm, seed, own AS target, truth, pred, count(*) AS n FROM aimed GROUP BY ALL")}
SELECT arm, target, count(*) AS runs, {_OVER}, sum(n)::BIGINT AS pooled FROM summary GROUP BY arm, target""")
def transfer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three training arms against two test sets, the size-matched arm once for each seed."""
    rows, (a, b) = zoned(spark, sf_dir), first_trees(spark, sf_dir)
    train, test = rows.where("split = 'train'"), rows.where(F.col("tree").isin(a, b) & (F.col("split") == "test"))
    quota = train.where(F.col("tree") == a).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(SEEDS).withColumnRenamed("id", "seed")
    drawn = op.drawn_sample(train.where(F.col("tree") == b).select("rel", "zone"), "rel", "zone", quota, every, "arm")
    arm = lambda name, part, seed: part.select(F.lit(name).alias("arm"), seed.cast("long").alias("seed"), "rel", F.lit("train").alias("role"))
    arms = arm("a_trained", train.where(F.col("tree") == a), F.lit(0)).unionByName(arm("b_trained_full", train.where(F.col("tree") == b), F.lit(0))).unionByName(arm("b_trained_matched", drawn, F.col("seed")))
    arms = written(arms, "arms")
    cases = arms.select("arm", "seed").distinct()  # as many as parameters ask for
    tests = test.select("rel", F.explode(F.lit(cases.agg(F.collect_list(F.struct("arm", "seed"))).scalar())).alias("x")).select("x.arm", "x.seed", "rel", F.lit("test").alias("role"))
    roles = written(arms.unionByName(tests), "roles")
    aimed = predicted(roles, rows, "arm", "seed").join(test.select("rel", F.when(F.col("tree") == a, "a_test").otherwise("b_test").alias("target")), "rel")
    cells = metrics.confusion(calls(aimed, rows).where("space = 'zone'"), "arm", "seed", "target")
    scores = metrics.summary(cells, "arm", "seed", "target")
    return metrics.over_runs(scores, "arm", "target").join(scores.groupBy("arm", "target").agg(F.sum("n").alias("pooled")), ["arm", "target"])


@query(f"""WITH RECURSIVE {RUNS}, tr AS (SELECT seed, rel, row_number() OVER (PARTITION BY seed ORDER BY {_draw("'inner'", "seed", "rel")}, rel) AS i, count(*) OVER (PARTITION BY seed) AS n FROM runs WHERE protocol = 'naive' AND role = 'train')
SELECT seed, count(*) FILTER (i <= greatest(6, round_even(n * 0.15, 0))) AS inner_validation, count(*) FILTER (i <= round_even(n * 0.2, 0)) AS fifth, sum(rel) FILTER (i <= greatest(6, round_even(n * 0.15, 0)))::BIGINT AS rels FROM tr GROUP BY seed""")
def inner_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each seed's train rows 15 %, but one for each of six classes at least; and a plain fifth."""
    roles = registry(zoned(spark, sf_dir), first_trees(spark, sf_dir)).where("protocol = 'naive' AND role = 'train'").select("seed", "rel")
    inner = op.held_slice(roles, "rel", "seed", 0.15, 6, "inner").select("seed", "rel", F.col("held").alias("inner"))
    fifth = op.held_slice(roles, "rel", "seed", 0.2, 0, "inner").select("seed", "rel", F.col("held").alias("fifth"))
    both = inner.join(fifth, ["seed", "rel"])
    return both.groupBy("seed").agg(F.count_if("inner").alias("inner_validation"), F.count_if("fifth").alias("fifth"), F.sum(F.when(F.col("inner"), F.col("rel"))).alias("rels"))


@query()
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification head on scaled vectors, its penalty chosen on an inner slice, saved, loaded and scored on the test rows.

    A multinomial regression takes the place of the reference's network, whose optimiser Spark lacks.
    """
    rows = zoned(spark, sf_dir)
    roles = registry(rows, first_trees(spark, sf_dir), 1).where("protocol = 'group'")
    known = rows.join(roles.select("rel", "role"), "rel")
    path = scratch(spark, "head")
    heads.fit(known.where("role = 'train'"), "rel", "vector", "zone").write().save(path)
    found = heads.load(path).transform(heads.assembled(known.where("role = 'test'"), "vector"))
    return metrics.summary(metrics.confusion(found.select(F.col("zone").alias("truth"), F.col("prediction").cast("long").alias("pred"))))


_PIXEL = "((vec_id + 1) * (k * k * 7 + k * 13 + 17)) % 251"


@query(f"""WITH px AS (SELECT vec_id, k // 32 AS i, k % 32 AS j, ({_PIXEL})::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1024)) AS k)
), c AS (SELECT u, i, cos(pi() * (2 * i + 1) * u / 64) * sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 32) AS c FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS i)
), y AS (SELECT vec_id, u, j, sum(c * x) AS y FROM px JOIN c USING (i) GROUP BY ALL
), z AS MATERIALIZED (SELECT vec_id, y.u * 8 + c.u AS nth, sum(y * c) AS z FROM y JOIN c ON c.i = y.j GROUP BY vec_id, y.u, c.u
), m AS (SELECT vec_id, list_sort(list(z) FILTER (nth > 0))[32] AS m FROM z GROUP BY vec_id)
SELECT vec_id, string_agg((z > m)::INT::VARCHAR, '' ORDER BY nth) AS bits FROM z JOIN m USING (vec_id) GROUP BY vec_id""")
def perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of 32 x 32 grey values made from ids."""
    pixels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long")), lambda k: (((F.col("vec_id") + 1) * (k * k * 7 + k * 13 + 17)) % 251).cast("double"))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", perceptual_bits(pixels).alias("bits"))
    return e.select("vec_id", F.lpad(F.bin("bits"), 64, "0").alias("bits"))


@query(f"""WITH RECURSIVE {RUNS}, {_nn("protocol, seed")}, d AS (SELECT unnest(range(5))::INT AS label), picked AS (
  SELECT a.label AS a, b.label AS b, c.label AS c, e.label AS e, g.label AS g FROM d a, d b, d c, d e, d g WHERE a.label < b.label AND a.label < c.label AND c.label < e.label AND len(list_distinct([a.label, b.label, c.label, e.label, g.label])) = 5
), parts AS (SELECT a || '+' || b || '|' || c || '+' || e || '|' || g AS partition, unnest([a, b, c, e, g]) AS label, unnest([0, 0, 1, 1, 2]) AS block FROM picked
), five AS (SELECT protocol, truth, pred, n FROM (SELECT protocol, six AS truth, six_pred AS pred, count(*) AS n FROM nn GROUP BY ALL) WHERE truth < 5 AND pred < 5
), base AS (SELECT max(v) - min(v) AS spread FROM (SELECT (coalesce(sum(n) FILTER (truth = pred), 0) / sum(n) - 0.2::DOUBLE) / 0.8::DOUBLE AS v FROM five GROUP BY protocol)
), swept AS (SELECT partition, protocol, (coalesce(sum(n) FILTER (x.block = y.block), 0) / sum(n) - 1 / 3.0::DOUBLE) / (2 / 3.0::DOUBLE) AS v FROM five JOIN parts x ON x.label = truth JOIN parts y USING (partition) WHERE y.label = pred GROUP BY ALL
), spreads AS (SELECT partition, max(v) - min(v) AS spread FROM swept GROUP BY partition)
SELECT partition, round(spreads.spread, 7) AS spread, round(1 - spreads.spread / nullif(base.spread, 0), 6) AS reduction, spreads.spread < base.spread AS more_stable, round(avg((spreads.spread < base.spread)::INT) OVER (), 7) AS share_more_stable FROM spreads, base""")
def partition_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each of the fifteen partitions of five labels narrows the spread of protocols, and the share that do."""
    from .audit import _partitions

    rows = zoned(spark, sf_dir)
    roles = written(registry(rows, first_trees(spark, sf_dir)), "roles")
    six = calls(predicted(roles, rows, "protocol", "seed"), rows).where("space = 'six' AND truth < 5 AND pred < 5")
    cells = written(metrics.confusion(six, "protocol"), "cells")
    hit = lambda same: F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum("n")
    base = cells.groupBy("protocol").agg(metrics.chance_corrected(hit(F.col("truth") == F.col("pred")), 5).alias("v")).agg((F.max("v") - F.min("v")).alias("base"))
    parts = _partitions(spark)
    x, y = (F.broadcast(parts.select("partition", F.col("label").cast("long").alias(c), F.col("block").alias(f"{c}_block"))) for c in ("truth", "pred"))
    swept = cells.join(x, "truth").join(y, ["partition", "pred"]).groupBy("partition", "protocol").agg(metrics.chance_corrected(hit(F.col("truth_block") == F.col("pred_block")), 3).alias("v"))
    spreads = swept.groupBy("partition").agg((F.max("v") - F.min("v")).alias("spread")).withColumn("base", base.scalar())
    stable = F.col("spread") < F.col("base")
    share = spreads.agg(F.avg(stable.cast("double"))).scalar()
    return spreads.select("partition", F.round("spread", 7).alias("spread"), F.round(1 - F.try_divide(F.col("spread"), F.col("base")), 6).alias("reduction"), stable.alias("more_stable"), F.round(share, 7).alias("share_more_stable"))
