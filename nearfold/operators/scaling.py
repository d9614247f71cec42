"""Scaling, projection and splits of vector tables (id, vec)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import fixed_hash
from ..functions.vectors import doubles, rescaled, standardised
from .sums import covariance, gram, merge_gram, vector_stats


def standardise(rows: DataFrame) -> DataFrame:
    """``vec`` with mean 0 and population deviation 1 by component; constant components are 0."""
    s = vector_stats(rows)
    out = rows.withColumn("vec", doubles("vec")).crossJoin(F.broadcast(s))  # one row
    return out.withColumn("vec", standardised(F.col("vec"), F.col("mean"), F.col("std"))).select(*rows.columns)


def min_max(rows: DataFrame, to_low: float = 0.0, to_high: float = 1.0) -> DataFrame:
    """``vec`` scaled into [to_low, to_high] by component."""
    s = vector_stats(rows)
    out = rows.withColumn("vec", doubles("vec")).crossJoin(F.broadcast(s))  # one row
    return out.withColumn("vec", rescaled(F.col("vec"), F.col("low"), F.col("high"), to_low, to_high)).select(*rows.columns)


def sample(rows: DataFrame, m: int, seed: str = "") -> DataFrame:
    """``m`` rows without replacement: those with the least hash of the id."""
    return rows.orderBy(fixed_hash(F.col("id"), seed), "id").limit(m)


def split(rows: DataFrame, m: int, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(targets, rest): a sample and its complement."""
    targets = sample(rows, m, seed)
    return targets, rows.join(targets.select("id"), "id", "left_anti")


class Pca:
    """Principal components of standardised vectors, from a Gram table that may be merged from parts.

    The d x d statistics are the only thing the driver sees.  Components are ordered by eigenvalue;
    of each the largest weight (in size) is positive.
    """

    def __init__(self, grams: DataFrame, components: int) -> None:
        rows = covariance(grams, 0).join(grams, ["grp", "i", "j"]).select("i", "j", "n", "si", "cov").toPandas()
        d = int(rows["i"].max()) + 1 if len(rows) else 0  # without rows a model of no features
        cov, mean = np.zeros((d, d)), np.zeros(d)
        cov[rows["i"], rows["j"]] = rows["cov"]
        mean[rows["i"]] = rows["si"] / rows["n"]
        self.n, self.mean, self.std = int(rows["n"].iloc[0]) if len(rows) else 0, mean, np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(self.std > 0, self.std, np.inf)
        values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        order = np.argsort(-values, kind="stable")[:components]
        self.values, w = values[order], vectors[:, order]
        if d:
            w = w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
        self.weights = w  # (d, components)

    @classmethod
    def fit(cls, rows: DataFrame, components: int) -> Pca:
        return cls(gram(rows), components)

    def table(self, spark) -> DataFrame:
        """(feature, component, weight, mean, std): the model as rows."""
        d, k = self.weights.shape
        return spark.createDataFrame([(i, j, float(self.weights[i, j]), float(self.mean[i]), float(self.std[i])) for i in range(d) for j in range(k)], "feature int, component int, weight double, mean double, std double")

    def save(self, spark, path: str) -> None:
        """The model's table as Parquet."""
        self.table(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Pca:
        """A saved model."""
        rows = spark.read.parquet(path).toPandas()  # a row per feature and component
        model = cls.__new__(cls)
        d, k = (int(rows[c].max()) + 1 if len(rows) else 0 for c in ("feature", "component"))
        model.weights, model.mean, model.std = np.zeros((d, k)), np.zeros(d), np.zeros(d)
        model.weights[rows["feature"], rows["component"]] = rows["weight"]
        model.mean[rows["feature"]], model.std[rows["feature"]] = rows["mean"], rows["std"]
        return model

    def transform(self, rows: DataFrame) -> DataFrame:
        """``vec`` projected on the components."""
        scale = np.where(self.std > 0, self.std, np.inf)
        w = self.weights / scale[:, None]
        shift = self.mean @ w
        columns = [F.array(*[F.lit(float(x)) for x in w[:, j]]) for j in range(w.shape[1])]
        dot = lambda c: F.aggregate(F.zip_with(doubles("vec"), c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return rows.withColumn("vec", F.array(*[dot(c) - F.lit(float(s)) for c, s in zip(columns, shift, strict=True)]).cast("array<double>"))


class IncrementalPca:
    """Principal components of batches that come one after the other: their Gram tables are added up."""

    def __init__(self, grams: DataFrame | None = None) -> None:
        self.grams = grams

    def add(self, rows: DataFrame) -> IncrementalPca:
        """The model with one more batch (id, vec)."""
        own = gram(rows)
        return IncrementalPca(own if self.grams is None else merge_gram(self.grams.unionByName(own)))

    def pca(self, components: int) -> Pca:
        return Pca(self.grams, components)

    def save(self, spark, path: str) -> None:
        self.grams.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> IncrementalPca:
        return cls(spark.read.parquet(path))
