"""Golden cases, properties and edge cases of the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfold.functions.vectors import cf_d2, cf_merge
from nearfold.operators import curves, pairs
from nearfold.operators.clusters import Birch, CfTree, assign, summary
from nearfold.operators.index import CellIndex, ClusterIndex, VantageIndex, VantageTree, median_tree
from nearfold.operators.knn import knn, ranked
from nearfold.operators.meet import meet
from nearfold.operators.quantiles import quantiles
from nearfold.operators.scaling import Pca, min_max, standardise
from nearfold.operators.sums import cluster_features
from nearfold.sources.text import grow, parse_tree, path_points

#: Small point sets with answers by hand.
SIX = [(8.0, 9.0), (9.0, 5.0), (6.0, 6.0), (3.0, 8.0), (4.0, 1.0), (1.0, 2.0)]
TOY = [(1.0, 1.5), (3.0, 9.0), (5.5, 7.0), (9.0, 8.0), (7.0, 3.1), (7.0, 1.6)]
TOY_TREE = ["Var. 1 > 3: ", "Var. 0 > 5: f(x)=0.0425", "Var. 0 <= 5 : f(x)=0.25", "Var. 1 <= 3 f(x)=1.5e-06"]


def table(spark, points, name="id"):
    return spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], f"{name} long, vec array<double>")


def found(df):
    return [(r.qid, r.id) for r in df.orderBy("qid", "rank").collect()]


def test_six_points(spark):
    q = spark.createDataFrame([(-1, [10.0, 10.0])], "qid long, vec array<double>")
    out = knn(q, table(spark, SIX), 5).orderBy("rank").collect()
    assert [r.id for r in out] == [0, 1, 2, 3, 4]
    assert [round(r.dist**2) for r in out] == [5, 26, 32, 53, 117]


def test_neighbour_across_a_split(spark):
    q = spark.createDataFrame([(-1, [7.0, 2.8])], "qid long, vec array<double>")
    out = CellIndex(table(spark, TOY), parse_tree(TOY_TREE)).knn(q, 1).collect()
    assert [(r.id, r.dist) for r in out] == [(4, 0.3)]


def test_tree_text():
    assert parse_tree(TOY_TREE) == {
        "axis": 1, "value": 3.0, "left": {"density": 1.5e-06},
        "right": {"axis": 0, "value": 5.0, "left": {"density": 0.25}, "right": {"density": 0.0425}},
    }
    deep = ["Var. 0 > -6: f(x)=1", "Var. 0 <= -6", "|\tVar. 1 > 7", "|\t|\tVar. 0 > -10: f(x)=2", "|\t|\tVar. 0 <= -10: f(x)=3", "|\tVar. 1 <= 7: f(x)=4"]
    assert parse_tree(deep)["left"]["right"] == {"axis": 0, "value": -10.0, "left": {"density": 3.0}, "right": {"density": 2.0}}
    assert parse_tree([]) == {}


def chebyshev(a, b):
    return np.abs(a[:, None, :] - b[None, :, :]).max(2)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", chebyshev])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_every_exact_index_agrees_with_brute_force(spark, k, metric):
    rng = np.random.default_rng(k)
    points = np.round(rng.random((300, 4)), 2)  # rounded: ties
    rows, queries = table(spark, points).cache(), table(spark, rng.random((15, 4)), "qid")
    want = found(knn(queries.withColumn("qid", -F.col("qid") - 1), rows, k, metric))
    queries = queries.withColumn("qid", -F.col("qid") - 1)
    centres = table(spark, points[::30], "cluster_id")
    members = assign(rows, centres, metric).join(rows, "id")
    assert found(ClusterIndex(members, centres, metric).knn(queries, k)) == want
    pivots = [(i, points[i].tolist()) for i in (0, 7, 100)]
    assert found(VantageIndex(rows, pivots, metric).knn(queries, k)) == want
    if not callable(metric):
        assert found(CellIndex(rows, median_tree(rows, 4, 3), metric).knn(queries, k)) == want
    assert found(VantageTree(rows, 6, point=points[0].tolist(), metric=metric).knn(queries, k)) == want
    assert found(VantageTree(rows, 3, 3, metric=metric).knn(queries, k)) == want


def test_boxes_take_no_other_metric(spark):
    with pytest.raises(ValueError, match="boxes"):
        CellIndex(table(spark, SIX), {}, chebyshev)


def clustered(rng, n=40, each=50, d=3):
    return (rng.random((n, 1, d)) * 100 + rng.normal(size=(n, each, d))).reshape(-1, d)


def test_second_round_plans_few_visits(spark):
    """Only leaves that may hold a nearer row are staged, out of many; nothing is lost."""
    rng = np.random.default_rng(12)
    points = clustered(rng)
    rows = table(spark, points).cache()
    queries = table(spark, points[::25] + 0.1, "qid").withColumn("qid", -F.col("qid") - 1).cache()
    want = found(knn(queries, rows, 4))
    far = np.sort(np.sqrt(((points[::25, None] + 0.1 - points[None]) ** 2).sum(2)), 1)[:, 3]
    for index, leaves in ((CellIndex(rows, median_tree(rows, 3, 6)), 64), (VantageTree(rows, 4, 3), 64)):
        assert found(index.knn(queries, 4)) == want
        visits = index.visits(queries, 4)
        assert visits.count() < 0.2 * queries.count() * leaves
        if isinstance(index, CellIndex):  # those that no plan could leave out
            assert visits.count() < 2 * visits.join(spark.createDataFrame([(-i - 1, float(t)) for i, t in enumerate(far)], "qid long, kth double"), "qid").filter("d <= kth").count()


@pytest.mark.parametrize("rows_block", [40, 100_000])
def test_block_join_and_vantage_blocks(spark, monkeypatch, rows_block):
    """Both sides cut into blocks; a task returns k rows a query at most, whatever its rows."""
    monkeypatch.setattr("nearfold.operators.index.grid", lambda q, r: __import__("nearfold.operators.knn", fromlist=["grid"]).grid(q, r, rows_block, 7))
    rng = np.random.default_rng(13)
    points = np.round(rng.random((500, 3)), 2)
    rows, queries = table(spark, points).cache(), table(spark, rng.random((30, 3)), "qid").withColumn("qid", F.col("qid") + 1_000).cache()
    d = np.sqrt(((np.array([r.vec for r in queries.orderBy("qid").collect()])[:, None] - points[None]) ** 2).sum(2)).round(9)
    want = [(1_000 + i, j) for i in range(30) for j in np.lexsort([np.arange(500), d[i]])[:5]]
    assert found(knn(queries, rows, 5, rows_block=rows_block, queries_block=7)) == want
    index = VantageIndex(rows, [(i, points[i].tolist()) for i in (0, 3)])
    sent = index.candidates(queries, 5)
    assert found(ranked(sent, 5)) == want
    parts = max(-(-500 // rows_block), 1)
    assert sent.count() <= 30 * 5 * parts
    kept = {r.qid: (r.candidates, r.least) for r in index.filtered(queries, 2).collect()}
    q, far = np.array([r.vec for r in queries.orderBy("qid").collect()]), lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).round(9)
    on = (far(points, points[[0, 3]])[None] < 2 * far(q, points[[0, 3]])[:, None]).all(2)
    assert kept == {1_000 + i: (int(on[i].sum()), d[i][on[i]].min()) for i in range(30) if on[i].any()}


def test_ids_of_text(spark):
    rows = table(spark, SIX).select(F.concat(F.lit("r"), "id").alias("id"), "vec")
    q = spark.createDataFrame([("r0", [9.0, 6.0])], "qid string, vec array<double>")
    assert found(knn(q, rows, 2)) == [("r0", "r1"), ("r0", "r2")]
    assert found(VantageTree(rows, 2, point=[0.0, 0.0]).knn(q, 1)) == [("r0", "r1")]


def test_more_neighbours_than_rows(spark):
    rows, q = table(spark, SIX), spark.createDataFrame([(-1, [0.0, 0.0])], "qid long, vec array<double>")
    assert knn(q, rows, 50).count() == 6
    assert CellIndex(rows, median_tree(rows, 2, 1)).knn(q, 50).count() == 6
    assert CellIndex(rows, {}).knn(q, 3).count() == 3
    assert VantageTree(rows, 2, point=[0.0, 0.0]).knn(q, 50).count() == 6
    assert VantageIndex(rows, [(0, [9.0, 6.0])]).knn(q, 50).count() == 6


def test_empty_tables(spark):
    none, q = table(spark, SIX).limit(0), spark.createDataFrame([(-1, [0.0, 0.0])], "qid long, vec array<double>")
    assert knn(q, none, 3).count() == knn(q.limit(0), table(spark, SIX), 3).count() == 0
    assert pairs.extreme_pair(none).count() == pairs.pair_histogram(none, 1.0).count() == standardise(none).count() == min_max(none).count() == 0
    assert Pca.fit(none, 2).transform(none).count() == 0 and Pca.fit(none, 2).weights.shape == (0, 0)
    assert Birch(1.0).fit(none).count() == assign(none, table(spark, SIX, "cluster_id")).count() == 0


def test_constant_component_scales_to_zero(spark):
    rows = table(spark, [(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)])
    assert [r.vec[1] for r in standardise(rows).collect()] == [0.0] * 3
    assert [r.vec[1] for r in min_max(rows, 2.0, 4.0).collect()] == [2.0] * 3


def test_pairs_of_repeated_points(spark):
    rows = table(spark, [(0.0, 0.0), (0.0, 0.0), (5.0, 0.0), (5.0, 1.0)])
    near, far = pairs.extreme_pair(rows).first(), pairs.extreme_pair(rows, closest=False).first()
    assert (near.a, near.b, near.dist) == (0, 1, 0.0) and (far.a, far.b) == (0, 3)
    assert {(r.a, r.b) for r in pairs.pairs_within(rows, 1.0).collect()} == {(0, 1), (2, 3)}
    assert pairs.pairs_within(rows, 0.0).count() == 1 and pairs.pairs_within(rows.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "sq_euclidean"])
def test_pairs_within_equal_all_pairs(spark, metric):
    """Bands, their blocks and ties lose no pair."""
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.random((150, 2)) * 20, np.round(rng.random((150, 2)), 1)])
    rows = table(spark, points).cache()
    d = pairs.distances(points, points, metric).round(9)
    for radius in (0.0, 0.5, 3.0):
        want = {(i, j) for i, j in np.argwhere(d <= radius).tolist() if i < j}
        got = [(r.a, r.b) for r in pairs.pairs_within(rows, radius, metric, tile=20).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    i, j = min(((x, y) for x, y in np.argwhere(np.triu(np.ones_like(d), 1) > 0).tolist()), key=lambda p: (d[p[0], p[1]], p))
    near = pairs.extreme_pair(rows, metric=metric, tile=20).first()
    assert (near.a, near.b) == (i, j)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "sq_euclidean"])
@pytest.mark.parametrize("width", [0.5, 25.0])
def test_pair_histogram_equals_all_pairs(spark, metric, width):
    rng = np.random.default_rng(3)
    points = np.concatenate([clustered(rng, 8, 60, 2), np.repeat(rng.random((1, 2)), 90, 0)])  # one point many times
    d = pairs.distances(points, points, metric).round(9)[np.triu_indices(len(points), 1)]
    bins, n = np.unique(np.floor(d / width).astype(int), return_counts=True)
    rows = table(spark, points).cache()
    assert {r.bin: r["n"] for r in pairs.pair_histogram(rows, width, metric).collect()} == dict(zip(bins.tolist(), n.tolist(), strict=True))
    small = pairs.pair_bins(rows, width, metric, block_rows=50).filter("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n"))
    assert {r.bin: r["n"] for r in small.collect()} == dict(zip(bins.tolist(), n.tolist(), strict=True))


def test_pair_histogram_measures_few_pairs(spark):
    """On clustered rows boxes count most pairs whole."""
    points = clustered(np.random.default_rng(4), 30, 100, 2)
    rows = table(spark, points).cache()
    for block_rows in (4_096, 300):
        work = {r.bin: r["n"] for r in pairs.pair_bins(rows, 50.0, block_rows=block_rows).groupBy("bin").agg(F.sum("n").alias("n")).collect()}
        measured = work.pop(-1)
        assert sum(work.values()) == 3_000 * 2_999 // 2 and measured < 0.2 * sum(work.values())


def test_pca_keeps_distances(spark):
    rows = table(spark, [(-1, -1), (-2, -1), (-3, -2), (1, 1), (2, 1), (3, 2)])
    a = np.array([r.vec for r in standardise(rows).orderBy("id").collect()])
    b = np.array([r.vec for r in Pca.fit(rows, 2).transform(rows).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(a[:, None] - a[None], axis=2), np.linalg.norm(b[:, None] - b[None], axis=2))


def test_blobs_are_found(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(m, s, (10, 2)) for m, s in ((10, 1.5), (20, 1.5), (30, 1.5), (40, 1), (50, 1))])
    rows, birch = table(spark, points), Birch(3.0)
    features = birch.fit(rows).collect()
    assert sum(r.n for r in features) == 50 and np.allclose(sum(np.array(r.ls) for r in features), points.sum(0))
    labels = {r.id: r.cluster_id for r in birch.labels(rows, spark.createDataFrame(features)).collect()}
    assert all(not ({labels[i] for i in range(a, a + 10)} & {labels[i] for i in range(b, b + 10)}) for a in range(0, 50, 10) for b in range(0, a, 10))


def test_birch_in_cells_keeps_its_contract(spark, monkeypatch):
    monkeypatch.setattr("nearfold.operators.clusters.CELL_FEATURES", 12)
    points = np.random.default_rng(3).random((300, 3)) * 10
    birch = Birch(1.0)
    features = birch.fit(table(spark, points), start=birch.fit(table(spark, points[:50])))
    got = features.collect()
    assert sum(r.n for r in got) == 350 and np.allclose(sum(np.array(r.ls) for r in got), points.sum(0) + points[:50].sum(0))
    radius = [max(0, r.ss / r.n - (np.array(r.ls) ** 2).sum() / r.n**2) ** 0.5 for r in got]
    assert max(radius) < 1.0 and len(got) < 250 and len({r.cluster_id for r in got}) == len(got)


def test_blobs_across_borders_are_one_cluster(spark, monkeypatch):
    """Blobs that the first tree's cells cut in two come together in the passes after it."""
    monkeypatch.setattr("nearfold.operators.clusters.CELL_FEATURES", 4)
    rng = np.random.default_rng(5)
    middles = np.array([[0.0, 0.0], [50.0, 3.0], [100.0, -4.0], [150.0, 8.0], [200.0, 0.0]])  # the middle one holds the median
    points = rng.permutation((middles[:, None] + rng.normal(size=(5, 80, 2)) * 0.5).reshape(-1, 2))
    features = Birch(2.0).fit(table(spark, points).repartition(8)).collect()
    assert sorted(r.n for r in features) == [80] * 5


def test_feature_tree_takes_blocks():
    """A block at once gives sums and radii as rows one by one do, in about as many features."""
    rng = np.random.default_rng(8)
    points = (rng.random((20, 1, 3)) * 50 + rng.normal(size=(20, 200, 3)) * 0.3).reshape(-1, 3)
    one, many = (CfTree(3, 1.0, "d0", "r", branching=6) for _ in range(2))
    for p in points:
        one.add(1, p, float(p @ p))
    many.add_block(np.ones(len(points)), points, (points**2).sum(1))
    n, ls, ss = many.leaves()
    assert n.sum() == 4_000 and np.allclose(ls.sum(0), points.sum(0)) and np.isclose(ss.sum(), (points**2).sum())
    assert (np.sqrt(np.maximum(ss / n - (ls**2).sum(1) / n**2, 0)) < 1.0).all() and len(n) <= 2 * len(one.leaves()[0])
    top = many.root
    while top.children is not None:  # inner entries hold what is below them
        for e in range(top.k):
            assert np.allclose(top.children[e].total()[1], top.ls[e]) and top.children[e].total()[0] == top.n[e]
        top = top.children[0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-50, 50), st.floats(-50, 50)), min_size=3, max_size=30))
def test_distance_of_merged_features(spark, points):
    """d2(A + B, C)^2 is the mean of d2(A, C)^2 and d2(B, C)^2 by size."""
    groups = {g: [p[1:] for p in points if p[0] == g] for g in (0, 1, 2)}
    if not all(groups.values()):
        return
    rows = spark.createDataFrame([(g, list(p)) for g, ps in groups.items() for p in ps], "g long, vec array<double>")
    f = {r.cluster_id: r for r in cluster_features(rows, "g").collect()}
    one = spark.createDataFrame([tuple((f[g].n, f[g].ls, f[g].ss) for g in (0, 1, 2))], ", ".join(f"c{g} struct<n:long,ls:array<double>,ss:double>" for g in (0, 1, 2)))
    a, b, c = F.col("c0"), F.col("c1"), F.col("c2")
    r = one.select(cf_d2(cf_merge(a, b), c).alias("m"), cf_d2(a, c).alias("x"), cf_d2(b, c).alias("y")).first()
    n1, n2 = f[0].n, f[1].n
    assert abs(r.m**2 - (n1 * r.x**2 + n2 * r.y**2) / (n1 + n2)) < 1e-6 * (1 + r.m**2)


def test_summary_of_clusters(spark):
    rows = table(spark, [(0, 0), (0, 3), (10, 0)])
    out = {r.cluster_id: r for r in summary(assign(rows, table(spark, [(0, 0), (10, 1)], "cluster_id"))).collect()}
    assert (out[0].size, out[0].radius, out[0].nearest) == (2, 3.0, 0.0) and (out[1].size, out[1].radius) == (1, 1.0)


def test_many_centres_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("nearfold.operators.clusters.CENTRE_BLOCK", 2)
    rows = table(spark, SIX)
    assert {r.id: r.cluster_id for r in assign(rows, table(spark, SIX, "cluster_id")).collect()} == {i: i for i in range(6)}


# --- curves ---------------------------------------------------------------------------------


def curve(spark, rows):
    return spark.createDataFrame(rows, "id long, band string, t double, mag double, key long")


def test_interpolation_hits_observations_exactly(spark):
    rows = curve(spark, [(1, "b", 0.0, 5.0, 0), (1, "b", 0.5, 7.0, 1), (1, "b", 0.5, 9.0, 2), (2, "b", 0.2, 1.0, 3)])
    out = {(r.id, r.g): r.mag for r in curves.interpolate(curves.fold(rows, 1.0), 2).collect()}
    assert out == {(1, 0): 5.0, (1, 1): 8.0, (2, 0): 1.0, (2, 1): 1.0}


def test_period_of_a_sine(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.random(400) * 60)
    rows = curve(spark, [(1, "b", float(x), float(np.sin(2 * np.pi * x / 4) + 10), i) for i, x in enumerate(t)])
    whole = curves.periods(rows, 0.05, 1.0, 96).first()
    assert abs(whole.period - 4) < 0.1
    split = curves.periodogram(rows, np.linspace(0.05, 1.0, 96), chunk=50).orderBy("f").toPandas()
    assert np.allclose(split.power, curves.periodogram(rows, np.linspace(0.05, 1.0, 96)).orderBy("f").toPandas().power)


def test_harmonics_of_two_waves(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.random(600) * 80)
    mag = 5 * np.sin(2 * np.pi * 0.25 * t) + 2 * np.cos(2 * np.pi * 0.5 * t) + 1.5 * np.sin(2 * np.pi * 0.4 * t) + 9
    r = curves.harmonics(curve(spark, [(1, "b", float(x), float(m), i) for i, (x, m) in enumerate(zip(t, mag, strict=True))]), 0.05, 1.0, 96, frequencies=2).first()
    assert abs(r.Freq1_harmonics_amplitude_0 - 5) < 0.3 and abs(r.Freq1_harmonics_amplitude_1 - 2) < 0.3 and abs(r.Freq2_harmonics_amplitude_0 - 1.5) < 0.3
    assert r.Freq1_harmonics_rel_phase_0 == 0 and abs(abs(r.Freq1_harmonics_rel_phase_1) - np.pi / 2) < 0.3


def test_features_of_odd_curves(spark):
    rows = curve(spark, [(1, "b", 0.0, 5.0, 0), (2, "b", 0.0, 3.0, 1), (2, "b", 1.0, 3.0, 2), (3, "b", None, 3.0, 3), (4, "b", 1.0, None, 4), (5, "b", 0.0, 1.0, 5), (5, "b", 0.0, 2.0, 6)])
    out = {r.id: r for r in curves.features(rows).collect()}
    assert set(out) == {1, 2, 5}
    assert out[1].Mean == 5.0 and out[1].Std == 0.0 and out[1].Skew is None and out[2].Rcs is None and out[5].MaxSlope is None


def test_alignment_takes_the_last_before(spark):
    rows = curve(spark, [(1, "B", 1.0, 1.0, 0), (1, "R", 1.0, 2.0, 1), (1, "R", 5.0, 3.0, 2), (1, "B", 9.0, 4.0, 3), (2, "B", 1.0, 1.0, 4)])
    assert [(r.t, r.t2) for r in curves.align(rows, "B", "R", 2.0).collect()] == [(1.0, 1.0)]
    assert {r.id: r.present for r in curves.pair_bands(rows, "B", "R").collect()} == {1: 0, 2: 1}


# --- quantiles, pruning, trees --------------------------------------------------------------


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_are_exact(spark, accuracy):
    """Also where the brackets are wide, with ties, one value, and a null group."""
    rng = np.random.default_rng(accuracy)
    groups = {"a": rng.normal(size=997), "b": np.round(rng.random(400), 1), "c": [3.0], "d": [1.0, 2.0], None: rng.random(50)}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)], "g string, x double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.grp: (r.n, r.q) for r in quantiles(rows, "g", "x", ps, accuracy).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and np.allclose(got[g][1], np.quantile(xs, ps))


def test_rings_prune_clustered_rows(spark):
    """Around the root of N rows less than half of the rows are candidates, and nothing is lost."""
    rng = np.random.default_rng(5)
    points = (rng.normal(size=(30, 1, 6)) * 8 + rng.normal(size=(30, 60, 6))).reshape(-1, 6)
    rows = table(spark, points).cache()
    queries = table(spark, points[::45] + 0.05, "qid").withColumn("qid", -F.col("qid") - 1)
    centres = table(spark, points[:: len(points) // 42], "cluster_id")
    index = ClusterIndex(assign(rows, centres).join(rows, "id"), centres)
    assert found(index.knn(queries, 5)) == found(knn(queries, rows, 5))
    work = index.metrics(queries, 5).collect()
    assert np.mean([r.step2 for r in work]) < len(points) / 2 and np.mean([r.n_clusters for r in work]) < 21


def test_cells_and_visits_in_parts(spark):
    """Hot cells and many visits are cut; the nearest are the same."""
    rng = np.random.default_rng(6)
    rows = table(spark, rng.random((200, 3))).select(F.lit(1).alias("cell"), "id", "vec", F.lit(0.0).alias("far"))
    visits = table(spark, rng.random((50, 3)), "qid").select("qid", F.col("vec").alias("qvec"), F.lit(1).alias("cell"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    whole, parts = meet(visits, rows, 4).collect(), meet(visits, rows, 4, rows_part=30, visits_part=7)
    assert sum(r.work for r in whole) == parts.agg(F.sum("work")).first()[0] == 200 * 50
    best = lambda df: {(r.qid, r["rank"]): (r.id, r.dist) for r in ranked(df.filter("id IS NOT NULL"), 4).collect()}
    assert best(parts) == best(meet(visits, rows, 4))
    assert meet(visits, rows.limit(0), 4).count() == meet(visits.limit(0), rows, 4).count() == 0


def test_feature_tree_splits_and_keeps_sums():
    rng = np.random.default_rng(7)
    points = rng.random((3_000, 2)) * 30
    tree = CfTree(2, 1.0, "d0", "r", branching=5)
    for p in points:
        tree.add(1, p, float(p @ p))
    n, ls, ss = tree.leaves()
    assert n.sum() == 3_000 and np.allclose(ls.sum(0), points.sum(0)) and np.isclose(ss.sum(), (points**2).sum())
    assert (np.sqrt(np.maximum(ss / n - (ls**2).sum(1) / n**2, 0)) < 1.0).all() and 100 < len(n) < 1_500

    def depth(node):
        assert node.k <= 5
        return 1 if node.children is None else 1 + max(map(depth, node.children[: node.k]))

    assert depth(tree.root) > 3


def test_global_clusters(spark):
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(m, 0.5, (40, 2)) for m in (0, 20, 40)])
    features = spark.createDataFrame(Birch(0.4).fit(table(spark, points)).collect())
    merged = {r.cluster_id: r.global_id for r in Birch.global_clusters(features, 3).collect()}
    sides = {(merged[r.cluster_id], round(r.ls[0] / r.n / 20)) for r in features.collect()}
    assert len(sides) == 3 and Birch.global_clusters(features.limit(0), 3).count() == 0


def test_tree_grown_by_rules():
    tree = grow(grow({"density": 1.0}, "", 0, 0.5), "1", 1, 2)
    assert tree == {"axis": 0, "value": 0.5, "left": {"density": 1.0}, "right": {"axis": 1, "value": 2.0, "left": {"density": 1.0}, "right": {"density": 1.0}}}


def test_slotted_autocorrelation_and_autoregression():
    rng = np.random.default_rng(11)
    t = np.sort(rng.random(80) * 40)
    y = rng.normal(size=80)
    y -= y.mean()
    i, j = np.triu_indices(80)
    slot = np.floor(t[j] - t[i] + 0.5)
    want = np.array([(y[i] * y[j])[slot == k].mean() for k in range(curves.SLOTS)])
    assert np.allclose(curves.slotted_autocorrelation(t, y), want / want[0])
    x, walk = 0.0, []
    for d in np.diff(np.r_[t[0] - 1, t]):
        a = np.exp(-d / 5.0)
        x = x * a + rng.normal() * np.sqrt(5.0 * 0.6**2 / 2 * (1 - a * a))
        walk.append(x)
    mean, sigma, tau = curves.autoregressive(t, np.array(walk) + 10, np.full(80, 0.01))
    assert 0.3 < sigma < 1.2 and 1 < tau < 25 and abs(mean * tau - np.mean(walk) - 10) < 1e-9


def test_paths_of_any_length(spark):
    path = "M 0 0 Q " + " ".join(f"{i} {i % 7} {i + 1} 0" for i in range(4_000))
    found_ = spark.createDataFrame([(1, path)], "id long, path string").select(path_points("path").alias("p")).first().p
    assert len(found_[1].nums) == 16_000


def test_quantiles_use_one_bracket(spark, monkeypatch):
    """Approximate quantiles may come out differently each time they are taken."""
    from os import urandom

    from nearfold.operators import quantiles as module

    random = lambda: urandom(1)[0] * 4.0
    plain, wider = F.percentile_approx, F.udf(lambda b: [x + (random() if i % 2 else -random()) for i, x in enumerate(b)], "array<double>").asNondeterministic()
    monkeypatch.setattr(module.F, "percentile_approx", lambda *a: wider(plain(*a)))
    rows = spark.range(101).select((F.col("id") % 2).alias("g"), (F.col("id") * F.col("id") / 7).alias("x"))
    for r in module.quantiles(rows, "g", "x", [0.25, 0.5]).collect():
        assert r.q == np.quantile([i * i / 7 for i in range(101) if i % 2 == r.grp], [0.25, 0.5]).tolist()


def test_rings_stage_no_visits(spark, monkeypatch):
    """As many clusters as rows, and rings that rule out little: no table of queries times clusters."""
    from nearfold.operators import index as module

    rng, rows_of, plain = np.random.default_rng(11), [], module.staged
    points = rng.normal(size=(120, 32))
    rows, queries = table(spark, points), table(spark, points[:20] + 0.1, "qid")
    centres = rows.withColumnRenamed("id", "cluster_id")
    monkeypatch.setattr(module, "staged", lambda df, name: rows_of.append((out := plain(df, name)).count()) or out)
    index = ClusterIndex(assign(rows, centres).join(rows, "id"), centres)
    near = {(r.qid, r["rank"]): r.id for r in index.knn(queries, 3).collect()}
    far = np.linalg.norm(points[:20, None] + 0.1 - points[None], axis=2)
    assert near == {(q, r + 1): int(i) for q in range(20) for r, i in enumerate(far[q].argsort()[:3])}
    assert max(rows_of) <= 120


def test_products_round_as_direct_distances():
    from nearfold.operators.blocks import distances, rounded

    rng = np.random.default_rng(12)
    a = rng.normal(size=(300, 64))
    b = np.concatenate([a[:50], a[:50] + 1e-9, a[:50] + 1e-5, rng.normal(size=(1_000, 64))])
    for scale, shift in ((1, 0), (1e3, 1e6), (1e-6, 0)):
        assert (rounded(a * scale + shift, b * scale + shift) == distances(a * scale + shift, b * scale + shift).round(9)).all()


def test_assignment_holds_few_distances():
    import tracemalloc

    from nearfold.operators import clusters

    x, centre = np.random.default_rng(13).normal(size=(2, 20_000, 4))
    tracemalloc.start()
    at, d = clusters._nearest(x[:4_000], centre, "euclidean")  # 640 MB of distances
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert (clusters.distances(x[:5], centre).argmin(1) == at[:5]).all()


@pytest.mark.parametrize("closest", [True, False])
def test_extreme_pair_measures_few_pairs(monkeypatch, closest):
    """Only pairs that may be the best are measured; ties go by ids, copies and odd components included."""
    import pandas as pd

    rng, measured, plain = np.random.default_rng(14), [], pairs.paired
    x = np.concatenate([rng.normal(size=(1_200, 16)), np.eye(16)[:2] * 40, -np.eye(16)[:2] * 40])
    x[700], x[900] = x[3], x[3]
    monkeypatch.setattr(pairs, "paired", lambda a, b, m: measured.append(len(a)) or plain(a, b, m))
    both = pd.DataFrame({"id": np.arange(len(x)), "vec": list(x)})
    a, b, d = pairs._extreme(both, both, True, "euclidean", closest)
    assert (a, b, d) == ((3, 700, 0.0) if closest else (1_200, 1_202, 80.0)) and sum(measured) < 2_000
    x[5, 5] = np.nan
    assert pairs._extreme(both.assign(vec=list(x)), both.assign(vec=list(x)), True, "euclidean", closest) == (a, b, d)


def test_histogram_by_products_counts_borders():
    """Distances on a bin's border, between copies and of odd components fall where direct ones do."""
    from collections import Counter

    x = np.concatenate([np.arange(40.0)[:, None] * 0.25, np.full((3, 1), 2.0)])
    for y in (x, x + 1e-10, np.r_[x, [[np.nan]]]):
        got, want = Counter(), Counter()
        pairs._count_between(got, x, y, 0.25, "euclidean")
        pairs._count(want, pairs.distances(x, y).round(9).ravel(), 0.25)
        assert got == want


def test_pair_histogram_has_no_bins_without_pairs(spark):
    """Copies leave bins between 0 and the others empty; like SQL's, the histogram has no rows for them, nor for a single row."""
    points = np.repeat(np.random.default_rng(6).normal(0, 1, (60, 16)), 2, 0)
    d = pairs.distances(points, points).round(9)[np.triu_indices(len(points), 1)]
    bins, n = np.unique(np.floor(d / 0.25).astype(int), return_counts=True)
    assert bins[0] == 0 and 1 not in bins
    rows = table(spark, points).cache()
    assert sorted(tuple(r) for r in pairs.pair_histogram(rows, 0.25).collect()) == list(zip(bins.tolist(), n.tolist(), strict=True))
    assert pairs.pair_histogram(rows.filter("id = 0"), 0.25).collect() == []


def test_vantage_points_that_rule_out_nothing_are_few():
    from nearfold.operators.index import _within

    q, x = np.zeros((8, 40)), np.ones((30, 40))
    q[0, 2] = 9
    on = _within(q, x, np.full((8, 1), 5.0))
    assert not on[0].any() and on[1:].all()
    q[1, 39] = 9  # beyond where the search ends: the pair is measured, which is no fault
    assert _within(q, x, np.full((8, 1), 5.0))[1].all()


def _one_at_a_time(t, mag, err):
    """The autoregressive fit of one curve, observation by observation and grid by grid."""
    low, high = np.log([1e-2, mag.std() * 1e-2]), np.log([10 * (t[-1] - t[0]), mag.std() * 1e2])
    x, noise, best = mag - mag.mean(), err**2, (-np.inf, 0.0, 0.0)
    for _ in range(curves.ROUNDS):
        for tau in np.exp(np.linspace(low[0], high[0], curves.TAUS)):
            for sigma in np.exp(np.linspace(low[1], high[1], curves.SIGMAS)):
                still = omega = tau * sigma**2 / 2
                guess, total = 0.0, -0.5 * (np.log(2 * np.pi * (omega + noise[0])) + x[0] ** 2 / (omega + noise[0]))
                for i in range(1, len(x)):
                    a, gain = np.exp(-(t[i] - t[i - 1]) / tau), omega / (omega + noise[i - 1])
                    guess, omega = a * (guess + gain * (x[i - 1] - guess)), still * (1 - a * a) + a * a * omega * (1 - gain)
                    total -= 0.5 * (np.log(2 * np.pi * (omega + noise[i])) + (guess - x[i]) ** 2 / (omega + noise[i]))
                if total > best[0]:
                    best = total, tau, sigma
        step = (high - low) / [curves.TAUS - 1, curves.SIGMAS - 1]
        low, high = np.log(best[1:]) - step, np.log(best[1:]) + step
    return mag.mean() / best[1], best[2], best[1]


def test_curves_are_fitted_together():
    """Curves of any lengths go through their observations together, and each gets what it gets alone."""
    rng = np.random.default_rng(4)
    own = [(np.sort(rng.random(n) * 30), rng.normal(50, 30, n), rng.choice([1.0, 0.5], n)) for n in (3, 9, 20, 9, 4)]
    got = curves.autoregressive_fits(own)
    assert np.allclose(got, [_one_at_a_time(*c) for c in own], rtol=1e-9)
    assert np.array_equal(got[1], curves.autoregressive(*own[1]))


def test_whole_curves_across_batches():
    ids = np.repeat([5, 7, 7, 9, None, 11], [3, 1, 6, 40, 2, 1]).tolist()
    table = pa.table({"id": pa.array(ids, pa.int64()), "t": pa.array(np.arange(len(ids), dtype=float))})
    for size in (1, 2, 7, 100):
        out = [(i, t[a:z].tolist()) for first, start, (t,) in curves.whole_curves(iter(table.to_batches(size))) for i, a, z in zip(first["id"].to_pylist(), start[:-1], start[1:], strict=True)]
        assert [i for i, _ in out] == [5, 7, 9, None, 11] and [len(t) for _, t in out] == [3, 7, 40, 2, 1]
        assert [x for _, t in out for x in t] == list(range(len(ids)))


def test_slots_need_no_fit(spark, monkeypatch):
    """The slotted autocorrelation alone makes no autoregressive fit."""
    rows = spark.range(60).select((F.col("id") % 2).alias("id"), F.col("id").cast("double").alias("t"), F.sin("id").alias("mag"))
    want = {r.id: r.SlottedA_length for r in curves.irregular_features(rows).collect()}
    monkeypatch.setattr(curves, "autoregressive_fits", None)
    assert {r.id: r.SlottedA_length for r in curves.irregular_features(rows, fits=False).collect()} == want
