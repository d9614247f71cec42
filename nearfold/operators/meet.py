"""Queries meet the rows of the cells they visit, dealt so that no task holds a whole cell or all its queries.

Cells of many rows and cells of many visits are cut into parts by hash; every part of the rows of a cell
meets every part of its visits, in numpy, inside one task.  Neither side passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Metric, distances, matrix

ROWS, VISITS = 16_384, 4_096


def meet(visits: DataFrame, rows: DataFrame, k: int, open_low: bool = False, rows_part: int = ROWS, visits_part: int = VISITS, metric: Metric = "euclidean") -> DataFrame:
    """(qid, id, dist, work): the k nearest rows of each visit, and a row without id that says how many it looked at.

    ``visits`` has (qid, qvec, cell, low, high), ``rows`` (cell, id, vec, far); looked at are the rows of the
    cell with low <= far <= high (low < far if ``open_low``).  Equal distances (to nine decimals) go by id.
    """
    kinds = dict(visits.dtypes)["qid"], dict(rows.dtypes)["id"]
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_part).cast("int").alias("parts"))
    qparts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / visits_part).cast("int").alias("qparts"))
    dealt = parts.join(qparts, "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.select("qid", "qvec", "cell", "low", "high").join(dealt, "cell")
    left = left.withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts")).cast("int")).withColumn("part", every("parts")).drop("parts", "qparts")
    right = rows.select("id", "vec", "cell", "far").join(dealt, "cell")
    right = right.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("qpart", every("qparts")).drop("parts", "qparts")
    keys = ["cell", "part", "qpart"]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "id", "dist", "work"]
        types = [left.schema.field("qid").type, right.schema.field("id").type, pa.float64(), pa.int64()]
        columns: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            far = right["far"].to_numpy()
            by = np.argsort(far, kind="stable")
            far, ids, x = far[by], right["id"].to_numpy()[by], matrix(right["vec"].combine_chunks())[by]
            qids, q = left["qid"].to_pylist(), matrix(left["qvec"].combine_chunks())
            begin = np.searchsorted(far, left["low"].to_numpy(), side="right" if open_low else "left")
            end = np.searchsorted(far, left["high"].to_numpy(), side="right")
            for i, (a, z) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                if z <= a:
                    continue
                d = distances(q[i : i + 1], x[a:z], metric)[0].round(9)
                at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                at = at[np.lexsort([ids[a:z][at], d[at]])][:k]
                columns[0] += [qids[i]] * (len(at) + 1)
                columns[1] += [*ids[a:z][at].tolist(), None]
                columns[2] += [*d[at].tolist(), None]
                columns[3] += [0] * len(at) + [z - a]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, f"qid {kinds[0]}, id {kinds[1]}, dist double, work long")
