"""The test tables as the engine's inputs, and SQL pieces that oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import days

QUERY_EVERY = 20


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec) from ``embeddings``."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def targets(rows: DataFrame) -> DataFrame:
    """(qid, vec): the stated query set, every row whose id is divisible by ``QUERY_EVERY``."""
    return rows.filter(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("qid"), "vec")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, band, t, mag, key) from ``events``: a curve per user, a band per event type, days since the epoch."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_type").alias("band"), days(F.col("ts")).alias("t"), F.col("value").alias("mag"), F.col("event_id").alias("key"))


def long_form(rows: DataFrame, name: str = "value", digits: int = 6) -> DataFrame:
    """(id, pos, value) of ``vec``."""
    return rows.select("id", F.posexplode("vec").alias("pos", name)).withColumn("pos", F.col("pos").cast("long")).withColumn(name, F.round(name, digits))


#: SQL: vectors, their components, queries, curves.
V = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
X = V + ", x AS (SELECT id, label, unnest(vec) AS val, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS pos FROM v)"
Q = V + ", q AS (SELECT id AS qid, vec FROM v WHERE id % 20 = 0)"
C = "c AS (SELECT user_id AS id, event_type AS band, epoch_us(ts) / 86400000000.0 AS t, value AS mag, event_id AS key FROM events)"
CENTRES = X + ", m AS (SELECT label, pos, avg(val) AS a FROM x GROUP BY label, pos), ctr AS (SELECT CAST(label AS BIGINT) AS cluster_id, list(a ORDER BY pos) AS centre FROM m GROUP BY label)"
