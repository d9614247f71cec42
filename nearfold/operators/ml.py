"""Feature ranking and accuracy by Spark ML, over vectors (id, vec, label)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles

SEED = 13


def _points(rows: DataFrame) -> DataFrame:
    return rows.select(array_to_vector(doubles("vec")).alias("features"), F.col("label").cast("double").alias("label"))


def importance(rows: DataFrame, trees: int = 50, depth: int = 8) -> DataFrame:
    """(pos, importance, rank) of the components of ``vec`` by a random forest; ties by position."""
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(_points(rows))
    own = model.featureImportances.toArray().tolist()
    order = sorted(range(len(own)), key=lambda i: (-own[i], i))
    return rows.sparkSession.createDataFrame([(p, own[p], r + 1) for r, p in enumerate(order)], "pos int, importance double, rank int")


def accuracy(rows: DataFrame, folds: int = 5, trees: int = 20, depth: int = 6) -> float:
    """Mean accuracy of a random forest over ``folds`` folds."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    return float(CrossValidator(estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=SEED, parallelism=2).fit(_points(rows)).avgMetrics[0])


def accuracy_by_width(rows: DataFrame, widths: list[int], folds: int = 5) -> DataFrame:
    """(width, accuracy) on the first ``width`` components."""
    found = [(w, accuracy(rows.withColumn("vec", F.slice("vec", 1, w)), folds)) for w in widths]
    return rows.sparkSession.createDataFrame(found, "width int, accuracy double")
