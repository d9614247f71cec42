"""Centroid clustering of integer vectors; nearest centroids by partial-distance search.

Components become integers, floor(``scale`` * x), and all arithmetic on them is exact.  Centroids start as
the vectors with the least SHA-256 of their id and a seed.  A round assigns every vector to its nearest
centroid (squared Euclidean distance; of equal ones the smaller number) and moves each centroid that
got vectors to the floor of their mean, component by component.

Nearest: dimensions are taken in order of falling variance, ``STEPS`` at a time.  The first of them give
every centroid a partial sum; the centroid with the least is measured in full and is the best so far.
A centroid is abandoned once its partial sum is strictly above the best; those still in the race take
the next dimensions, and finish all of them if they stay.  Whoever finishes lower becomes the best of its
vector for the steps that follow.  Partial sums only grow, so no nearest centroid is abandoned, and
ties survive to be settled by number.

Tasks sum the vectors of each centroid in integers before the shuffle, which carries one row per
task, centroid and dimension; vectors themselves never move, so a vector that a third of the rows
repeat is no hot group.  The driver holds the ``k`` centroids.

Defined cases: vectors that are null, hold null or non-finite components or have another length are left
out; components beyond 2^53 in size are set to 2^53, and distances and sums beyond the range of long to
its largest number (``EXACT`` bounds what is computed in 64 bits; larger components take Python's
integers); a null id never seeds before others; ids may repeat, then the lesser vector seeds first; with
fewer than ``k`` vectors each is a centroid; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, staged

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
STEPS = (8, 16, 32, 48)
LARGEST = 1 << 53
EXACT = 1 << 27  # below this, 64-bit integers hold the squared distance of 64 components
BLOCK = 4_096

# --- vectors --------------------------------------------------------------------------------


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are vectors of ``dims`` finite components, and those as integers."""
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
    flat = pc.list_flatten(column.filter(pa.array(right)))
    x = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null: NaN
    finite = np.isfinite(x).all(1)
    right[np.flatnonzero(right)[~finite]] = False
    with np.errstate(over="ignore"):
        return right, np.clip(np.floor(x[finite] * scale), -LARGEST, LARGEST).astype(np.int64)


def quantized(vectors: DataFrame, column: str, ints: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The rows of ``vectors`` whose ``column`` is a vector, with its integers in ``ints``."""
    at = vectors.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, v = integers(batch.column(at), dims, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dims, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(on)).columns, lists], [*batch.schema.names, ints])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(ints, T.ArrayType(T.LongType()))]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dims)


# --- partial-distance search ------------------------------------------------------------------


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row, its squared distance, and the squared differences taken.

    ``order``: the dimensions, those of high variance first.
    """
    if max(np.abs(x).max(initial=0), max(map(abs, centroids.ravel().tolist()))) >= EXACT:
        x, centroids = x.astype(object), centroids.astype(object)
    else:
        x, centroids = x.astype(np.int64), centroids.astype(np.int64)
    x, c = x[:, order], centroids[:, order]
    n, dims = x.shape
    ends = [*(s for s in STEPS if s < dims), dims]
    part = np.zeros((n, len(c)), x.dtype)
    for d in range(ends[0]):
        part += (x[:, d, None] - c[None, :, d]) ** 2
    taken = part.size * ends[0]
    guess = part.argmin(1)
    best = ((x - c[guess]) ** 2).sum(1)
    taken += n * dims
    row, at = np.nonzero(part <= best[:, None])
    sums = part[row, at]
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        sums = sums + ((x[row, a:z] - c[at, a:z]) ** 2).sum(1)
        taken += len(row) * (z - a)
        on = sums <= best[row]
        row, at, sums = row[on], at[on], sums[on]
        if z < dims:  # of each row the one ahead is measured in full: it may be a lower best
            lead = np.lexsort([at, sums, row])
            lead = lead[np.r_[True, row[lead][1:] != row[lead][:-1]]]
            lead = lead[at[lead] != guess[row[lead]]]
            full = sums[lead] + ((x[row[lead], z:] - c[at[lead], z:]) ** 2).sum(1)
            taken += len(lead) * (dims - z)
            best[row[lead]] = np.minimum(best[row[lead]], full)
    by = np.lexsort([at, sums, row])
    by = by[np.r_[True, row[by][1:] != row[by][:-1]]] if len(by) else by
    return at[by], sums[by], taken


# --- rounds ---------------------------------------------------------------------------------


def _by_variance(rows: DataFrame, ints: str, dims: int) -> np.ndarray:
    """Dimensions by falling variance; sums in doubles, as order is all they are for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, n = np.zeros(dims), np.zeros(dims), 0
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            total, square, n = total + x.sum(0), square + (x * x).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total), pa.array(square), pa.array([n] * dims)], ["d", "s", "q", "n"])

    sums = rows.select(ints).mapInArrow(run, "d int, s double, q double, n long").groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).toPandas()
    sums = sums.sort_values("d")
    n = np.maximum(sums["n"].to_numpy(), 1)
    return np.argsort(-(sums["q"].to_numpy() / n - (sums["s"].to_numpy() / n) ** 2).round(6), kind="stable") if len(sums) else np.arange(dims)


def _moved(rows: DataFrame, ints: str, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after one round."""
    dims = len(centroids[0])
    held = rows.sparkSession.sparkContext.broadcast((np.array(centroids, np.int64), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, by = held.value
        n, sums = np.zeros(len(at), np.int64), np.zeros((len(at), dims), object)
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            x = _matrix(batch.column(0), dims)
            own, *_ = nearest(x, at, by)
            n += np.bincount(own, minlength=len(at))
            for c in np.unique(own).tolist():
                sums[c] += x[own == c].sum(0)  # at most BLOCK components below 2^53
        on = np.flatnonzero(n)
        cells = pa.array([int(v) for v in sums[on].ravel()], pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(on, dims)), pa.array(np.tile(np.arange(dims), len(on))), pa.array(np.repeat(n[on], dims)), cells], ["c", "d", "n", "s"])

    found = rows.select(ints).mapInArrow(run, "c long, d long, n long, s decimal(38,0)").groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    out = [list(c) for c in centroids]
    for c, d, n, s in found.collect():  # a row per centroid and dimension
        out[c][d] = int(s) // n
    held.destroy()
    return out


def _assigned(rows: DataFrame, ints: str, centroids: list[list[int]], order: np.ndarray, names: tuple[str, str]) -> DataFrame:
    dims, at = len(centroids[0]), rows.columns.index(ints)
    held = rows.sparkSession.sparkContext.broadcast((np.array(centroids, np.int64), order))
    kept = [f for f in rows.schema.fields if f.name != ints]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            own, distance, _ = nearest(_matrix(batch.column(at), dims), *held.value)
            far = np.minimum(distance, 2**63 - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(own.astype(np.int32)), pa.array(far)], [*(f.name for f in kept), *names])

    schema = T.StructType([*kept, T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.LongType())])
    return rows.mapInArrow(run, schema)


def seeds(rows: DataFrame, id_column: str, ints: str, k: int, seed: str = SEED) -> list[list[int]]:
    """The vectors with the least SHA-256 of ``seed:id``; of equal ids the lesser vector first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"), 256)
    return [list(r[0]) for r in rows.select(ints, h.alias("nf_hash")).orderBy(F.asc_nulls_last("nf_hash"), ints).limit(k).collect()]  # k rows


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """The rows that are vectors with ``cluster`` (int) and ``distance`` (long), and the final centroids."""
    ints = free_name(vectors.columns, "nf_ints")
    rows = staged(quantized(vectors, column, ints, dims, scale), "vectors")
    centroids = seeds(rows, id_column, ints, k, seed)
    names = (free_name(vectors.columns, "cluster"), free_name(vectors.columns, "distance"))
    if not centroids:
        return rows.drop(ints).withColumns({names[0]: F.lit(0), names[1]: F.lit(0).cast("long")}), []
    order = _by_variance(rows, ints, dims)
    for _ in range(rounds):
        centroids = _moved(rows, ints, centroids, order)
    return _assigned(rows, ints, centroids, order, names), centroids


def _long(total: Column) -> Column:
    return F.least(total, F.lit(2**63 - 1)).cast("long")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, both sums of distances and the digest of its centroid for every vector."""
    out, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    out = staged(out.select("vec_id", "cluster", "distance"), "assigned")
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    top = 2**63 - 1
    named = [(c, min(sums.get(c, 0), top), min(sum(sums.values()), top), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS MATERIALIZED (
  SELECT row_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN cent{r} USING (dim) GROUP BY row_id, c),
own{r} AS MATERIALIZED (
  SELECT row_id, c, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1),""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
  SELECT c, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM own{r} JOIN parts USING (row_id) GROUP BY c, dim),
cent{r + 1} AS MATERIALIZED (
  SELECT c, dim, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM cent{r} LEFT JOIN mean{r} USING (c, dim)),""")
    body = "\n".join(steps)
    return f"""
WITH listed AS (
  SELECT row_number() OVER () AS row_id, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}),
opened AS (
  SELECT row_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS dim FROM listed),
whole AS (
  SELECT row_id FROM opened GROUP BY row_id HAVING count(*) FILTER (WHERE isfinite(e)) = {dims}),
parts AS MATERIALIZED (
  SELECT row_id, dim, CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM opened SEMI JOIN whole USING (row_id)),
vectors AS (
  SELECT row_id, list(x ORDER BY dim) AS v FROM parts GROUP BY row_id),
first AS (
  SELECT row_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c
  FROM listed JOIN vectors USING (row_id) QUALIFY c < {k}),
cent0 AS MATERIALIZED (
  SELECT c, dim, x AS y FROM first JOIN parts USING (row_id)),
{body}
digest AS (
  SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM cent{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM own{rounds} JOIN listed USING (row_id) JOIN digest USING (c)
"""


QUERIES = {"op13_centroids": op13_centroids}
ORACLE_SQL = {"op13_centroids": _sql()}
