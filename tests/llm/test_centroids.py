"""op13 against its SQL, and partial-distance search against all distances."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfold.llm import centroids

from ..oracle import database, differences
from .helpers import save

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_agree_with_sql(spark, tmp_path, parts):
    folder = save(spark.read.parquet(f"{SMALL}/embeddings.parquet").repartition(parts), tmp_path, "embeddings")
    assert differences(centroids.op13_centroids(spark, folder), database(SMALL), centroids.ORACLE_SQL["op13_centroids"]) == []


def strange_vectors():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 64)).astype(np.float32)
    v[5:9] = v[4]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(100, None, 0), (101, [], 0), (102, [1.0] * 63, 0), (103, [1.0] * 65, 0), (104, [None, *[1.0] * 63], 0), (105, [math.nan] + [1.0] * 63, 0)]
    return rows + [(106, [math.inf] + [0.0] * 63, 0), (107, [-math.inf] * 64, 0), (7, v[50].tolist(), 1), (7, v[7].tolist(), 2), (108, [0.0, -0.0] * 32, None)]


def test_strange_vectors_agree_with_sql(spark, tmp_path):
    folder = save(spark.createDataFrame(strange_vectors(), SCHEMA), tmp_path, "embeddings")
    con = database(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert differences(centroids.op13_centroids(spark, folder), con, centroids.ORACLE_SQL["op13_centroids"]) == []


def plain(x, c):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    return [min(range(len(c)), key=lambda j: (r[j], j)) for r in d], [min(r) for r in d]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([2, 5, 64, 70]), st.sampled_from([3, 300, 2**26, 2**52]), st.integers(1, 12))
def test_nearest_is_the_least_of_all(seed, dims, size, k):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size, (30, dims)), rng.integers(-size, size, (k, dims))
    x[:5] = c[0]
    c[-1] = c[0]
    own, far, _ = centroids.nearest(x, c, rng.permutation(dims))
    assert (own.tolist(), far.tolist()) == plain(x, c)


def test_partial_distances_save_work():
    rng = np.random.default_rng(1)
    spread = np.r_[np.full(8, 400.0), np.full(56, 20.0)]
    c = (rng.normal(size=(40, 64)) * spread).astype(np.int64)
    x = c[rng.integers(40, size=2_000)] + (rng.normal(size=(2_000, 64)) * spread / 4).astype(np.int64)
    own, far, taken = centroids.nearest(x, c, np.argsort(-x.var(0)))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (own == full.argmin(1)).all() and (far == full.min(1)).all() and taken < 0.3 * full.size * 64


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 5)), 1.0], 0) for i in range(20)] + [(50, [3e38, 0.0], 0)]
    got, at = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=6, dims=2)
    assert {r.distance for r in got.collect()} == {0} and sorted(at)[-1] == [2**53, 0]


def test_few_none_and_clashing_names(spark, tmp_path):
    some = spark.createDataFrame(strange_vectors()[:3], SCHEMA)
    got, at = centroids.cluster(some)
    assert len(at) == 3 and {r.distance for r in got.collect()} == {0}
    none = spark.createDataFrame([(1, [1.0], 0), (None, None, None)], SCHEMA)
    folder = save(none, tmp_path, "embeddings")
    assert centroids.op13_centroids(spark, folder).count() == 0
    assert centroids.op13_centroids(spark, save(none.limit(0), tmp_path, "embeddings")).count() == 0
    clash = some.withColumn("cluster", F.lit("mine")).withColumn("nf_ints", F.lit(1)).withColumn("my col", F.lit(2))
    out, _ = centroids.cluster(clash)
    assert out.columns == [*clash.columns, "_cluster", "distance"] and {r.cluster for r in out.collect()} == {"mine"}


def test_null_ids_do_not_seed(spark):
    rows = [(None, [float(i)] * 64, 0) for i in range(50)] + [(i, [100.0 + i] * 64, 0) for i in range(40)]
    assert all(c[0] >= 25_600 for c in centroids.seeds(centroids.quantized(spark.createDataFrame(rows, SCHEMA), "embedding", "ints"), "vec_id", "ints", 40))
