"""Mergeable sums over vectors: one pass, one small table, for scaling, cluster features and PCA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import matrix

HELD = 8_000_000  # numbers that a task holds before it passes on what it has summed


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    g, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
    for v in np.unique(g):
        yield v, x[g == v]


def column_sums(rows: DataFrame, group: str | None = None) -> DataFrame:
    """(grp, pos, n, s, ss, low, high) of ``vec`` by group and component, added up per task first."""

    def done(held: dict) -> Iterator[pa.RecordBatch]:
        for g, (n, s, ss, low, high) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g, np.int64)), pa.array(np.arange(len(n), dtype=np.int64)), pa.array(n.astype(np.int64)), *map(pa.array, (s, ss, low, high))], ["grp", "pos", "n", "s", "ss", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for g, x in _groups(batch):
                new = [np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
                old = held.get(g)
                held[g] = new if old is None else [*(a + b for a, b in zip(old[:3], new[:3], strict=True)), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
            if len(held) > HELD // 5 // max(1, len(next(iter(held.values()))[0])):
                yield from done(held)
                held = {}
        yield from done(held)

    base = rows.select((F.col(group) if group else F.lit(0)).cast("long"), F.col("vec").cast("array<double>"))
    parts = base.mapInArrow(run, "grp long, pos long, n long, s double, ss double, low double, high double")
    sums = [F.sum(c).alias(c) for c in ("n", "s", "ss")]
    return parts.groupBy("grp", "pos").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))


def gram(rows: DataFrame, group: str | None = None) -> DataFrame:
    """(grp, i, j, n, si, sj, sij): the mergeable statistics of covariance, by group."""

    def done(held: dict) -> Iterator[pa.RecordBatch]:
        for g, (n, s, xx) in held.items():
            d = len(s)
            i, j = (a.ravel().astype(np.int64) for a in np.indices((d, d)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, g, np.int64)), pa.array(i), pa.array(j), pa.array(np.full(d * d, n, np.int64)), pa.array(s[i]), pa.array(s[j]), pa.array(xx.ravel())], ["grp", "i", "j", "n", "si", "sj", "sij"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for g, x in _groups(batch):
                n, s, xx = held.get(g, (0, 0.0, 0.0))
                held[g] = n + len(x), s + x.sum(0), xx + x.T @ x
            if len(held) > HELD // max(1, next(iter(held.values()))[2].size):
                yield from done(held)
                held = {}
        yield from done(held)

    base = rows.select((F.col(group) if group else F.lit(0)).cast("long"), F.col("vec").cast("array<double>"))
    parts = base.mapInArrow(run, "grp long, i long, j long, n long, si double, sj double, sij double")
    return merge_gram(parts)


def merge_gram(parts: DataFrame) -> DataFrame:
    """Gram tables added up, whatever batches, fields or streams they come from."""
    return parts.groupBy("grp", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def covariance(grams: DataFrame, ddof: int = 1) -> DataFrame:
    """(grp, i, j, cov) from a Gram table."""
    return grams.select("grp", "i", "j", ((F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - ddof)).alias("cov"))


def correlation(grams: DataFrame) -> DataFrame:
    """(grp, i, j, corr) from a Gram table; 0 for constant components."""
    var = covariance(grams, 0)
    diagonal = var.filter("i = j").select("grp", F.col("i").alias("k"), F.col("cov").alias("v"))
    left, right = diagonal.withColumnsRenamed({"k": "i", "v": "vi"}), diagonal.withColumnsRenamed({"k": "j", "v": "vj"})
    both = var.join(left, ["grp", "i"]).join(right, ["grp", "j"])
    return both.select("grp", "i", "j", F.when(F.col("vi") * F.col("vj") <= 0, 0.0).otherwise(F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))).alias("corr"))


def vector_stats(rows: DataFrame) -> DataFrame:
    """One row: arrays mean, std (population), low, high over the components of ``vec``."""
    s = column_sums(rows)
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    s = s.select("pos", mean.alias("mean"), F.when(F.col("high") == F.col("low"), 0.0).otherwise(std).alias("std"), "low", "high")
    return s.agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std", "low", "high"))).alias("x")).select("x.mean", "x.std", "x.low", "x.high")


def cluster_features(rows: DataFrame, group: str) -> DataFrame:
    """(cluster_id, n, ls, ss) by group."""
    s = column_sums(rows, group)
    out = s.groupBy("grp").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("x"), F.sum("ss").alias("ss"))
    return out.select(F.col("grp").alias("cluster_id"), "n", F.col("x.s").alias("ls"), "ss")


def merge_cluster_features(parts: DataFrame) -> DataFrame:
    """Cluster features (cluster_id, n, ls, ss) of several batches added up."""
    each = parts.select("cluster_id", "n", "ss", F.posexplode("ls").alias("pos", "s"))
    s = each.groupBy("cluster_id", "pos").agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.sum("s").alias("s"))
    first = W.partitionBy("cluster_id")
    out = s.withColumn("n", F.max("n").over(first)).groupBy("cluster_id", "n").agg(F.max("ss").alias("ss"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("x"))
    return out.select("cluster_id", "n", F.col("x.s").alias("ls"), "ss")
