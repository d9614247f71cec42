"""Incremental models over streams: each micro-batch adds its mergeable sums to a table.

The sums of a batch are written under its batch id, replacing what an earlier try left, so a batch
that is tried again after a failure counts once.  Merging reads all batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sums import cluster_features, gram, merge_cluster_features, merge_gram


def _feed(stream: DataFrame, path: str, sums: Callable[[DataFrame], DataFrame], available_now: bool) -> StreamingQuery:
    def add(batch: DataFrame, batch_id: int) -> None:
        sums(batch).write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def feed_gram(stream: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Add the Gram sums of vectors (vec) as they come."""
    return _feed(stream, path, gram, available_now)


def feed_cluster_features(stream: DataFrame, path: str, group: str, available_now: bool = True) -> StreamingQuery:
    """Add the cluster features of vectors (group, vec) as they come."""
    return _feed(stream, path, lambda batch: cluster_features(batch, group), available_now)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/batches").drop("batch")


def merged_gram(spark: SparkSession, path: str) -> DataFrame:
    return merge_gram(_batches(spark, path))


def merged_cluster_features(spark: SparkSession, path: str) -> DataFrame:
    return merge_cluster_features(_batches(spark, path))
