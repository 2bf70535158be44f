"""Classification heads on stored vectors, by Spark's own estimators."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .resampling import held_slice

#: The penalties that are tried.
PENALTIES = (1e-4, 1e-2)


def assembled(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit(rows: DataFrame, key: str, vector: str, label: str, share: float = 0.15) -> PipelineModel:
    """A scaler and a multinomial regression; the penalty of the best macro F1 on an inner slice (ties: the smaller one)."""
    classes = rows.select(label).distinct().count()
    held = held_slice(assembled(rows, vector).withColumn("__all", F.lit(0)), key, "__all", share, classes, "head").withColumn("y", F.col(label).cast("double")).cache()
    best = None
    for penalty in PENALTIES:
        stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="y", regParam=penalty, maxIter=50)]
        model = Pipeline(stages=stages).fit(held.where(~F.col("held")))
        found = model.transform(held.where("held")).select(F.col(label).alias("truth"), F.col("prediction").cast("long").alias("pred"))
        score = metrics.summary(metrics.confusion(found)).first().macro_f1
        if best is None or score > best[0]:
            best = (score, model)
    held.unpersist()
    return best[1]


def load(path: str) -> PipelineModel:
    """K6: a saved head."""
    return PipelineModel.load(path)
