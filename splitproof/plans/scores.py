"""Evaluation of predictions: the labels of ``embeddings`` as their nearest neighbour predicts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as op
from ..operators.neighbours import nearest
from .catalog import query

#: A fifth of the vectors, by a multiplicative hash, are queries; the others are the base. Groups of ten vectors are runs.
NN = """d AS (
  SELECT t.vec_id AS id, t.label AS truth, b.label AS pred, b.vec_id AS nn_id, list_sum(list_transform(list_zip(t.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dist
  FROM embeddings t, embeddings b WHERE (t.vec_id * 2654435761) % 100 < 20 AND (b.vec_id * 2654435761) % 100 >= 20
), nn AS (
  SELECT id, truth::BIGINT AS truth, pred::BIGINT AS pred, nn_id, id % 4 AS seed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nn_id) AS r FROM d) WHERE r = 1
)"""
CELLS = f"{NN}, cells AS (SELECT seed, truth, pred, count(*) AS n FROM nn GROUP BY ALL)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    test = (F.col("id") * 2654435761) % 100 < 20
    nn = nearest(e.where(~test), e.where(test))
    return e.where(test).select("id", F.col("label").alias("truth")).join(nn, "id").select("id", "truth", F.col("nn_label").alias("pred"), "nn_id", (F.col("id") % 4).alias("seed"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.confusion(predictions(spark, sf_dir), "seed")


@query(f"WITH {NN} SELECT id, truth, pred, nn_id, seed FROM nn")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the nearest other vector."""
    return predictions(spark, sf_dir)


@query(f"WITH {NN}, k AS (SELECT DISTINCT label::BIGINT AS class FROM embeddings) SELECT t.class AS truth, p.class AS pred, (SELECT count(*) FROM nn WHERE nn.truth = t.class AND nn.pred = p.class) AS n FROM k t, k p")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled over runs, all cells."""
    classes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("class")).distinct()
    return op.dense(op.confusion(predictions(spark, sf_dir)), classes)


PER_CLASS = f"""{CELLS}, u AS (
  SELECT seed, truth AS class, n AS support, 0 AS predicted, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM cells UNION ALL SELECT seed, pred, 0, n, 0 FROM cells
), k AS (SELECT seed, class, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM u GROUP BY seed, class
), c AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM k)"""


@query(f"WITH {PER_CLASS} SELECT seed, class, tp, support, predicted, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM c")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    out = op.per_class(cells(spark, sf_dir), "seed")
    return out.select("seed", "class", "tp", "support", "predicted", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


SUMMARY = f"""{PER_CLASS}, s AS (
  SELECT seed, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS acc, avg(recall) FILTER (support > 0) AS bal, avg(f1) AS f1, sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS e FROM c GROUP BY seed
), summary AS (SELECT seed, n, round(acc, 9) AS accuracy, round(bal, 9) AS balanced_accuracy, round(f1, 9) AS macro_f1, round(CASE WHEN e < 1 THEN (acc - e) / (1 - e) ELSE 0 END, 9) AS kappa FROM s)"""


@query(f"WITH {SUMMARY} SELECT * FROM summary")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11-A13, A15 for each run."""
    return op.summary(cells(spark, sf_dir), "seed")


@query(f"""WITH {PER_CLASS}, l AS (SELECT unnest(range(12)) AS class), g AS (SELECT DISTINCT seed FROM cells)
SELECT g.seed, round(avg(coalesce(f1, 0)), 9) AS uf1, round(avg(coalesce(recall, 0)), 9) AS uar FROM g CROSS JOIN l LEFT JOIN c ON c.seed = g.seed AND c.class = l.class GROUP BY g.seed""")
def fixed_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over twelve labels, two of which never occur."""
    return op.fixed_label_means(cells(spark, sf_dir), spark.range(12).select(F.col("id").alias("class")), "seed")


@query(f"""WITH {SUMMARY} SELECT count(accuracy) AS n, round(avg(accuracy), 9) AS mean, round(coalesce(stddev_samp(accuracy), 0), 9) AS std_sample, round(stddev_pop(accuracy), 9) AS std_population,
  round(quantile_cont(accuracy, 0.025), 9) AS p2_5, round(quantile_cont(accuracy, 0.5), 9) AS p50, round(quantile_cont(accuracy, 0.95), 9) AS p95, round(quantile_cont(accuracy, 0.975), 9) AS p97_5, round(max(accuracy) - min(accuracy), 9) AS range FROM summary""")
def run_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A18, A23-A25 over the runs."""
    return op.spread(run_summary(spark, sf_dir), "accuracy")


@query(f"WITH {SUMMARY} SELECT seed, accuracy, kappa FROM (SELECT *, row_number() OVER (ORDER BY accuracy, seed) - 1 AS i, count(*) OVER () AS n2 FROM summary) WHERE i = n2 // 2")
def median_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    return op.median_run(run_summary(spark, sf_dir), "accuracy", "seed").select("seed", "accuracy", "kappa")


@query(f"WITH {SUMMARY} SELECT arg_max(seed, (accuracy, kappa, -seed)) AS seed FROM summary")
def best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: by accuracy, then kappa, then the lower seed."""
    return op.best_by(run_summary(spark, sf_dir).withColumn("tie", -F.col("seed")), "seed", [("accuracy", True), ("kappa", True), ("tie", True)])


#: Two label spaces: all ten labels, and five pairs of them.
@query(f"""WITH {NN}, s AS (
  SELECT seed, 'ten' AS space, 10 AS k, avg((truth = pred)::INT) AS acc FROM nn GROUP BY seed UNION ALL SELECT seed, 'five', 5, avg((truth // 2 = pred // 2)::INT) FROM nn GROUP BY seed
), c AS (SELECT space, avg(acc) AS raw, avg((acc - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k)) AS corrected, max((acc - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k)) - min((acc - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k)) AS spread FROM s GROUP BY space)
SELECT round(f.raw - t.raw, 9) AS raw_gain, round(f.corrected - t.corrected, 9) AS corrected_gain, round(f.spread, 9) AS spread_five, round(t.spread, 9) AS spread_ten, round(1 - f.spread / nullif(t.spread, 0), 9) AS spread_reduction FROM c f, c t WHERE f.space = 'five' AND t.space = 'ten'""")
def label_space_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fewer classes gain before and after chance correction, and how far they narrow the spread of runs."""
    nn = predictions(spark, sf_dir)
    hit = lambda same: F.avg(same.cast("double"))
    runs = nn.groupBy("seed").agg(hit(F.col("truth") == F.col("pred")).alias("ten"), hit(F.floor(F.col("truth") / 2) == F.floor(F.col("pred") / 2)).alias("five"))
    ten, five = op.chance_corrected(F.col("ten"), 10), op.chance_corrected(F.col("five"), 5)
    spread_five, spread_ten = F.max(five) - F.min(five), F.max(ten) - F.min(ten)
    return runs.agg(
        F.round(F.avg("five") - F.avg("ten"), 9).alias("raw_gain"),
        F.round(F.avg(five) - F.avg(ten), 9).alias("corrected_gain"),
        F.round(spread_five, 9).alias("spread_five"),
        F.round(spread_ten, 9).alias("spread_ten"),
        F.round(1 - F.try_divide(spread_five, spread_ten), 9).alias("spread_reduction"),
    )


@query("""WITH c AS (SELECT lang AS class, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), w AS (SELECT *, 1.0::DOUBLE / n AS i, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS e FROM c)
SELECT class, n, round(n / sum(n) OVER (), 9)::DOUBLE AS share, round(i / avg(i) OVER (), 9) AS inverse, round(e / avg(e) OVER (), 9) AS effective, round(sum(n) OVER () / n, 9)::DOUBLE AS ratio FROM w""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20-A22 for the languages."""
    counts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL").groupBy(F.col("lang").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return op.class_weights(counts)


#: Zones of the labels 0-5; 6 and 7 have none, 8 and 9 are unknown to the map.
@query(f"""WITH {NN}, z AS (SELECT *, CASE WHEN truth < 6 THEN truth // 2 END AS zone, CASE WHEN pred < 6 THEN pred // 2 WHEN pred < 8 THEN NULL ELSE -1 END AS pred_zone FROM nn)
SELECT zone, count(*) AS n, round(avg((pred_zone IS NOT DISTINCT FROM zone)::INT), 9) AS recall, round(count(*) FILTER (pred_zone IS DISTINCT FROM zone) / nullif((SELECT count(*) FROM z WHERE zone IS NOT NULL AND pred_zone IS DISTINCT FROM zone), 0), 9)::DOUBLE AS error_share
FROM z WHERE zone IS NOT NULL GROUP BY zone""")
def zone_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels mapped to zones (none, or -1 for the unknown), recall in each and its share of all errors."""
    dim = spark.createDataFrame([(i, i // 2 if i < 6 else None) for i in range(8)], "label long, zone long").withColumn("known", F.lit(True))
    side = lambda n: F.broadcast(dim.select(F.col("label").alias(n), F.col("zone").alias(f"{n}_zone"), F.col("known").alias(f"{n}_known")))
    z = predictions(spark, sf_dir).join(side("truth"), "truth", "left").join(side("pred"), "pred", "left").where(F.col("truth_zone").isNotNull())
    wrong = ~F.when(F.col("pred_known").isNull(), F.lit(-1).cast("long")).otherwise(F.col("pred_zone")).eqNullSafe(F.col("truth_zone"))
    rows = z.groupBy(F.col("truth_zone").alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"))
    total = rows.agg(F.sum("errors").alias("all"))
    return rows.join(F.broadcast(total)).select("zone", "n", F.round(1 - F.col("errors") / F.col("n"), 9).alias("recall"), F.round(F.try_divide(F.col("errors").cast("double"), F.col("all").cast("double")), 9).alias("error_share"))
