"""One boosted-tree classifier for each (section, branch, action), its artifacts, scoring and ensemble means."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def train(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 5, step: float = 0.1, seed: int = 0) -> PipelineModel | None:
    """A model of y (boolean) from features (null: 0); positives weigh as much as negatives together. None if a class has
    no row. Rows with a null y don't count."""
    known = rows.filter("y is not null").select(F.col("y").cast("double").alias("label"), *(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    weighted = known.withColumn("weight", F.when(F.col("label") == 1, n[0.0] / n[1.0]).otherwise(1.0))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(assembler.transform(weighted))
    return PipelineModel([assembler, model])


def score(rows: DataFrame, features: list[str], models: Iterable[PipelineModel], to: str = "prob") -> DataFrame:
    """rows with the mean of the models' probabilities of the positive class."""
    had = rows.columns
    out = rows.select("*", *(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"_in_{i}") for i, f in enumerate(features)))
    probs = []
    for k, m in enumerate(models):
        assembler, trees = VectorAssembler(inputCols=[f"_in_{i}" for i in range(len(features))], outputCol="_x"), m.stages[1].copy({m.stages[1].featuresCol: "_x"})
        seen = trees.transform(assembler.transform(out))
        out = seen.withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
        probs.append(F.col(f"_p{k}"))
    return out.select(*had, (sum(probs[1:], probs[0]) / len(probs)).alias(to))


def ensemble_mean(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prob): mean over the members of an ensemble (rows of one key)."""
    return scores.groupBy(*keys).agg(F.avg("prob").alias("prob"))


def available(models: DataFrame, actions: DataFrame) -> DataFrame:
    """Models (action, ...) whose action is listed for the recordings at hand."""
    return models.join(actions.select("action").distinct(), "action", "left_semi")


def area_under_pr(scored: DataFrame, prob: str = "prob") -> float:
    """Of rows (y, prob)."""
    rows = scored.select(F.col("y").cast("double").alias("label"), F.col(prob).alias("p"))
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName="areaUnderPR").evaluate(rows)


def metric_for(positive_share: float | None) -> str:
    """Area under the precision-recall curve where both classes are there, else log loss."""
    return "logLoss" if positive_share in (None, 0.0, 1.0) else "areaUnderPR"


def save(model: PipelineModel, path: str, section: int, branch: str, action: str, features: list[str]) -> None:
    """The model under section, branch and action, and a manifest row with its ordered features."""
    model.write().overwrite().save(f"{path}/models/section={section}/branch={branch}/action={action}")
    row = [(section, branch, action, features)]
    spark = SparkSession.active()
    spark.createDataFrame(row, "section int, branch string, action string, features array<string>").write.mode("overwrite").parquet(f"{path}/manifest/section={section}/branch={branch}/action={action}/row")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(section, branch, action, features) of every saved model."""
    return spark.read.schema("section int, branch string, action string, features array<string>").option("recursiveFileLookup", "true").parquet(f"{path}/manifest")


def load(path: str, section: int, branch: str, action: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/models/section={section}/branch={branch}/action={action}")
