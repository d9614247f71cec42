"""Exact k nearest neighbours without an index: a block join, and the measure for every index.

Queries and rows are cut into blocks by the hash of their ids, and every two blocks meet in a task, which
keeps the k best of its queries; only those go on.  Neither side passes through the driver, and the
blocks bound what a task holds, whatever the sizes of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from .blocks import Best, Metric, matrix, names, rounded

ROWS_BLOCK, QUERIES_BLOCK = 16_384, 4_096
ROW_SLICE, QUERY_SLICE = 1_024, 512


def grid(queries: DataFrame, rows: DataFrame, rows_block: int = ROWS_BLOCK, queries_block: int = QUERIES_BLOCK, dealt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``queries`` (qid, ...) and ``rows`` (id, ...) with ``part`` and ``qpart``, every block of one beside every block of the other.

    Small tables are cut finer, so that all cores have work.  Rows of one ``dealt`` stay in one block, by default those of one id.
    """
    n, m = rows.count(), queries.count()
    parts = max(1, -(-n // rows_block), min(rows.sparkSession.sparkContext.defaultParallelism, n // ROW_SLICE))
    qparts = max(1, -(-m // queries_block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.withColumn("qpart", F.pmod(F.xxhash64("qid"), F.lit(qparts)).cast("int")).withColumn("part", every(parts))
    right = rows.withColumn("part", F.pmod(F.xxhash64("id") if dealt is None else dealt, F.lit(parts)).cast("int")).withColumn("qpart", every(qparts))
    return left, right


def best_rows(best: Best, qids: pa.Array, id_type: pa.DataType, columns: tuple[str, str, str] = ("qid", "id", "dist")) -> pa.Table:
    """What ``best`` holds, as rows."""
    ids = np.zeros(0, np.int64) if best.i is None else best.i
    return pa.table([qids.take(pa.array(best.row)), pa.array(ids.tolist(), id_type), pa.array(best.d)], columns)


def ranked(found: DataFrame, k: int, dist: str = "dist") -> DataFrame:
    """The k best rows (qid, id, dist) of each query, with ``rank``; ties by id."""
    order = W.partitionBy("qid").orderBy(dist, "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, catalogue: DataFrame, k: int, metric: Metric = "euclidean", rows_block: int = ROWS_BLOCK, queries_block: int = QUERIES_BLOCK) -> DataFrame:
    """(qid, id, dist, rank) for queries (qid, vec) and catalogue (id, vec); a row is no neighbour of its own id.

    Equal distances (to nine decimals) are ranked by id.
    """
    kinds = dict(queries.dtypes)["qid"], dict(catalogue.dtypes)["id"]
    left, right = grid(queries.select("qid", doubles("vec").alias("vec")), catalogue.select("id", doubles("vec").alias("vec")), rows_block, queries_block)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, id_type = left["qid"].combine_chunks(), right.schema.field("id").type
        asked, own, parts = names(qids), names(right["id"]), []
        if left.num_rows and right.num_rows:
            q, x = matrix(left["vec"].combine_chunks()), matrix(right["vec"].combine_chunks())
            for a in range(0, len(q), QUERY_SLICE):
                best = Best(len(q[a : a + QUERY_SLICE]), k)
                for b in range(0, len(x), ROW_SLICE):
                    d = rounded(q[a : a + QUERY_SLICE], x[b : b + ROW_SLICE], metric)
                    if asked.dtype.kind == own.dtype.kind:
                        d[asked[a : a + QUERY_SLICE, None] == own[None, b : b + ROW_SLICE]] = np.inf
                    best.add(d, own[b : b + ROW_SLICE])
                parts.append(best_rows(best, qids.slice(a, QUERY_SLICE), id_type))
        return pa.concat_tables(parts or [best_rows(Best(0, k), qids.slice(0, 0), id_type)])

    keys = ["part", "qpart"]
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, f"qid {kinds[0]}, id {kinds[1]}, dist double"), k)
