"""Queries over cluster features, clusters and pruned search."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import CF_DISTANCES, cf_diameter, cf_merge, cf_radius
from ..operators.clusters import Birch, assign, summary
from ..operators.index import CellIndex, ClusterIndex, VantageIndex, VantageTree, cost, median_tree
from ..operators.scaling import sample
from ..operators.sums import cluster_features, merge_cluster_features
from ..operators.trees import located
from ..shared import new_path, staged
from ..sources.features import read_clusters, write_clusters
from ..streaming.merge import feed_cluster_features, merged_cluster_features
from .common import CENTRES, Q, V, X, targets, vectors
from .vectors import K

POINTS, NEAREST = 10, 3
DEPTH, SHELLS, WIDTH = 4, 8, 64
BRANCHING, LEVELS = 5, 3
THRESHOLD = 0.9
GLOBAL = 50
SWEEP = (4, 12, 20)
RADII = (0.8, 0.9, 1.0)


def _features(rows: DataFrame) -> DataFrame:
    return cluster_features(rows, "label").select("cluster_id", F.struct("n", "ls", "ss").alias("cf"))


def cf_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster_features(vectors(spark, sf_dir), "label").select("cluster_id", "n", "ss", F.posexplode("ls").alias("pos", "ls"))
    return out.select("cluster_id", "n", F.round("ss", 5).alias("ss"), F.col("pos").cast("long").alias("pos"), F.round("ls", 5).alias("ls"))


def cf_radius_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(vectors(spark, sf_dir))
    return f.select("cluster_id", F.round(cf_radius(F.col("cf")), 6).alias("radius"), F.round(cf_diameter(F.col("cf")), 6).alias("diameter"))


def cf_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d0 to d4 between the features of each label and the next."""
    f = staged(_features(vectors(spark, sf_dir)), "features")
    other = f.select((F.col("cluster_id") - 1).alias("cluster_id"), F.col("cf").alias("b"))
    return f.join(other, "cluster_id").select("cluster_id", *[F.round(d(F.col("cf"), F.col("b")), 5).alias(n) for n, d in CF_DISTANCES.items()])


def cf_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each label merged with those of the next: count and radius of the union."""
    f = staged(_features(vectors(spark, sf_dir)), "features")
    other = f.select((F.col("cluster_id") - 1).alias("cluster_id"), F.col("cf").alias("b"))
    both = f.join(other, "cluster_id").select("cluster_id", cf_merge(F.col("cf"), F.col("b")).alias("cf"))
    return both.select("cluster_id", F.col("cf.n").alias("n"), F.round(cf_radius(F.col("cf")), 6).alias("radius"))


def cf_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two batches, then merged: as those of all rows at once."""
    rows = vectors(spark, sf_dir)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    both = cluster_features(rows.filter(half), "label").unionByName(cluster_features(rows.filter(~half), "label"))
    out = merge_cluster_features(both)
    return out.select("cluster_id", "n", F.round("ss", 5).alias("ss"))


def stream_cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over a folder of files, four at a time: each micro-batch adds its features."""
    source, path = new_path(spark, "arrivals"), new_path(spark, "stream")
    rows = vectors(spark, sf_dir).select("label", "vec")
    rows.repartition(12).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    feed_cluster_features(stream, path, "label").awaitTermination()
    return merged_cluster_features(spark, path).select("cluster_id", "n", F.round("ss", 5).alias("ss"))


def _centres(rows: DataFrame) -> DataFrame:
    return Birch.centres(cluster_features(rows, "label"))


def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return assign(rows, _centres(rows)).select("id", "cluster_id", F.round("dist", 6).alias("dist"))


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    s = summary(assign(rows, _centres(rows)))
    return s.select("cluster_id", "size", F.round("radius", 6).alias("radius"), F.round("nearest", 6).alias("nearest"))


def cluster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and clusters written, read again, and one cluster's members by rank of distance."""
    rows = vectors(spark, sf_dir)
    path, centres = new_path(spark, "clusters"), _centres(rows)
    found = assign(rows, centres)
    write_clusters(found.join(rows.select("id", "vec"), "id"), summary(found), path)
    members, clusters = read_clusters(spark, path)
    return members.filter("cluster_id = 3").join(clusters, "cluster_id").select("id", F.col("cluster_id").cast("long").alias("cluster_id"), "size", F.round("dist", 6).alias("dist"))


def _birch(rows: DataFrame) -> DataFrame:
    """Features of the rows of even ids, continued with those of odd ids as a second batch."""
    birch, even = Birch(THRESHOLD), F.col("id") % 2 == 0
    return staged(birch.fit(rows.filter(~even), start=staged(birch.fit(rows.filter(even)), "first")), "features")


def birch_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of BIRCH over the table, in two batches."""
    cf = F.struct("n", "ls", "ss")
    return _birch(vectors(spark, sf_dir)).select("cluster_id", "n", F.round(cf_radius(cf), 6).alias("radius"))


def birch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of BIRCH whatever the order: features add up to the data and stay below the threshold, and
    every row and every feature has one cluster."""
    rows = vectors(spark, sf_dir)
    features, cf = _birch(rows), F.struct("n", "ls", "ss")
    total = F.aggregate("ls", F.lit(0.0), lambda a, x: a + x)
    sums = features.agg(F.sum("n").alias("n"), F.round(F.sum(total), 4).alias("ls"), F.round(F.sum("ss"), 4).alias("ss"), F.coalesce(F.bool_and((cf_radius(cf) < THRESHOLD) | (F.col("n") == 1)), F.lit(True)).alias("below"))
    labels = Birch(THRESHOLD).labels(rows, features).join(features.select("cluster_id"), "cluster_id").agg(F.count_distinct("id").alias("labelled"), F.count(F.lit(1)).alias("labels"))
    merged = Birch.global_clusters(features, GLOBAL).agg((F.count_distinct("global_id") <= GLOBAL).alias("few"), (F.count(F.lit(1)) == F.count_distinct("cluster_id")).alias("once"))
    return sums.crossJoin(labels).crossJoin(merged)  # one row each


def birch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    out = Birch(THRESHOLD).labels(rows, _birch(rows))
    return out.select("id", "cluster_id", F.round("dist", 6).alias("dist"))


def _index(rows: DataFrame, clusters: int | None = None) -> ClusterIndex:
    """Around as many rows, those of the least hash; the root of the number of rows unless given."""
    centres = sample(rows, clusters or int(sqrt(rows.count())), "c1").select(F.col("id").alias("cluster_id"), "vec")
    members = staged(assign(rows, centres).join(rows.select("id", "vec"), "id"), "members")
    return ClusterIndex(members, centres)


def _result(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def _cluster_knn(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return _result(_index(rows).knn(_lifted(rows), K, rule))

    return run


def _lifted(rows: DataFrame) -> DataFrame:
    """The stated queries, moved off their own rows by 0.01 in each component."""
    return targets(rows).select("qid", F.transform("vec", lambda x: x + 0.01).alias("vec"))


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _index(rows).metrics(_lifted(rows), K, "exact")


def search_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean work of the queries by rule, and the cost of disk accesses it stands for."""
    rows = vectors(spark, sf_dir)
    index, queries = _index(rows), staged(_lifted(rows), "queries")
    parts = [cost(index.metrics(queries, K, rule), WIDTH).withColumn("rule", F.lit(rule)) for rule in ("exact", "memory", "disk")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("rule", *[F.round(c, 6).alias(c) for c in ("avg_step1", "avg_step2", "avg_disk", "cost")])


def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean work of the same queries by number of clusters."""
    rows = vectors(spark, sf_dir)
    queries, parts = staged(_lifted(rows), "queries"), []
    for n in SWEEP:
        parts.append(_index(rows, n).metrics(queries, K, "exact").withColumn("clusters", F.lit(n).cast("long")))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("clusters").agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("step1", "step2", "n_clusters")])


def radius_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries around the clusters of BIRCH by its radius: the neighbours are the same, whatever the clusters."""
    rows = vectors(spark, sf_dir)
    queries, n, parts = staged(_lifted(rows), "queries"), rows.count(), []
    for radius in RADII:
        features = staged(Birch(radius).fit(rows), "features")
        index = ClusterIndex(staged(assign(rows, Birch.centres(features)).join(rows.select("id", "vec"), "id"), "members"), Birch.centres(features))
        near = index.knn(queries, K).agg(F.count_distinct("qid").alias("queries"), F.round(F.sum("dist"), 4).alias("dist"))
        work = index.metrics(queries, K).agg(((F.max("step2") <= n) & (F.max("n_clusters") <= F.max("step1"))).alias("bounded"))
        parts.append(near.crossJoin(work).withColumn("radius", F.lit(radius)))  # one row each
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _points(rows: DataFrame) -> list:
    return [(r.id, list(r.vec)) for r in rows.orderBy("id").limit(POINTS).collect()]


def vantage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that the filter leaves each query, by the ``NEAREST`` of the ``POINTS`` lowest ids."""
    rows = vectors(spark, sf_dir)
    found = VantageIndex(rows, _points(rows)).filtered(_lifted(rows), NEAREST)
    return found.select("qid", "candidates", F.round("least", 6).alias("nearest"))


def vantage_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _result(VantageIndex(rows, _points(rows)).knn(_lifted(rows), K))


def kd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by cell of a tree of medians."""
    rows = vectors(spark, sf_dir)
    return located(rows, median_tree(rows, WIDTH, DEPTH)).groupBy(F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))


def cell_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _result(CellIndex(rows, median_tree(rows, WIDTH, DEPTH)).knn(_lifted(rows), K))


def shell_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    """Shells around the row of the lowest id."""
    first = rows.orderBy("id").limit(1).collect()
    return _result(VantageTree(rows, SHELLS, point=first[0].vec if first else None).knn(_lifted(rows), K))


def vp_tree_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vantage-point tree of ``LEVELS`` levels."""
    rows = vectors(spark, sf_dir)
    return _result(VantageTree(rows, BRANCHING, LEVELS).knn(_lifted(rows), K))


QUERIES = {f.__name__: f for f in (
    cf_by_label, cf_radius_diameter, cf_distances, cf_merged, cf_incremental, stream_cluster_features, cluster_assign, cluster_summary, cluster_files,
    birch_clusters, birch_labels, birch_sums, cluster_sweep, radius_sweep, search_metrics, search_cost, vantage_filter, vantage_knn, kd_cells, cell_knn, shell_knn, vp_tree_knn,
)} | {f"cluster_knn_{rule}": _cluster_knn(rule) for rule in ("exact", "memory", "disk")}

_LIFTED = Q.replace("SELECT id AS qid, vec FROM v", "SELECT id AS qid, list_transform(vec, lambda e: e + 0.01) AS vec FROM v")
_BRUTE = f"""
WITH {_LIFTED}, d AS (SELECT qid, v.id, round(list_distance(q.vec, v.vec), 9) AS dist FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {K}"""
_CF = X + ", s AS (SELECT CAST(label AS BIGINT) AS k, pos, count(*) AS n, sum(val) AS ls, sum(val * val) AS ss FROM x GROUP BY label, pos), cf AS (SELECT k, any_value(n) AS n, list(ls ORDER BY pos) AS ls, sum(ss) AS ss, sum(ls * ls) AS l2 FROM s GROUP BY k)"
_AB = _CF + """, ab AS (SELECT a.k, a.n AS n1, b.n AS n2, a.ss AS s1, b.ss AS s2, a.l2 AS a2, b.l2 AS b2, list_dot_product(a.ls, b.ls) AS ab,
  list_distance(list_transform(a.ls, lambda e: e / a.n), list_transform(b.ls, lambda e: e / b.n)) AS far,
  list_sum(list_transform(list_zip(a.ls, b.ls), lambda p: abs(p[1] / a.n - p[2] / b.n))) AS man FROM cf a JOIN cf b ON b.k = a.k + 1),
mm AS (SELECT *, n1 + n2 AS n, s1 + s2 AS ss, a2 + b2 + 2 * ab AS l2 FROM ab)"""
_MEMBERS = """, ad AS (SELECT v.id, v.vec, cluster_id, round(list_distance(v.vec, centre), 9) AS dist FROM v, ctr),
mem AS (SELECT id, any_value(vec) AS vec, arg_min(cluster_id, (dist, cluster_id)) AS cluster_id, min(dist) AS dist FROM ad GROUP BY id),
cl AS (SELECT cluster_id, count(*) AS size, max(dist) AS radius, min(dist) AS nearest FROM mem GROUP BY cluster_id)"""
_ASSIGN = CENTRES + _MEMBERS
_ROOTS = V + ", ctr AS (SELECT id AS cluster_id, vec AS centre FROM v ORDER BY md5(id || 'c1'), id LIMIT (SELECT {limit} FROM v))" + _MEMBERS
_ROOT_OF_N = "CAST(floor(sqrt(count(*))) AS BIGINT)"


def _steps_sql(rule: str, limit: str = _ROOT_OF_N) -> str:
    """CTEs up to ``vis`` (visited clusters) and ``cand`` (candidates) of a rule."""
    tau = {
        "exact": f"tau AS (SELECT qid, max(u) AS tau FROM (SELECT qid, d + dist AS u, row_number() OVER (PARTITION BY qid ORDER BY d + dist, id) AS r FROM seeds JOIN mem USING (cluster_id)) WHERE r <= {K} GROUP BY qid)",
        "disk": "tau AS (SELECT qid, max(d) AS tau FROM seeds GROUP BY qid)",
        "memory": "tau AS (SELECT qid, list_reduce(list_concat([{'d': 0.0, 'nearest': 0.0, 't': 0.0}], list({'d': d, 'nearest': nearest, 't': 0.0} ORDER BY d, cluster_id)), lambda acc, e: {'d': 0.0, 'nearest': 0.0, 't': CASE WHEN e.d > acc.t THEN e.d + e.nearest ELSE acc.t END}).t AS tau FROM seeds GROUP BY qid)",
    }[rule]
    reach = "radius + tau - d >= -1e-9" if rule == "exact" else "radius + tau - d > 0"
    ring = "abs(m.dist - d) <= tau + 1e-9" if rule == "exact" else "m.dist > d - tau"
    lifted = _LIFTED.split(", q AS ", 1)[1]
    return f"""
WITH {_ROOTS.replace('{limit}', limit)}, q AS {lifted},
pr AS (SELECT qid, q.vec AS qvec, cl.*, round(list_distance(q.vec, centre), 9) AS d FROM q, cl JOIN ctr USING (cluster_id)),
sd AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY qid ORDER BY d, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {K} AS seed FROM pr),
seeds AS (SELECT * FROM sd WHERE seed), {tau},
vis AS (SELECT sd.*, tau FROM sd JOIN tau USING (qid) WHERE seed OR {reach}),
cand AS (SELECT qid, m.id, round(list_distance(qvec, m.vec), 9) AS dist FROM vis JOIN mem m USING (cluster_id) WHERE {ring})"""


_RANKED = f", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM cand) SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {K}"
_WORK = ", s1 AS (SELECT count(*) AS step1 FROM cl), s2 AS (SELECT qid, count(*) AS step2 FROM cand GROUP BY qid), nv AS (SELECT qid, count(*) AS n_clusters FROM vis GROUP BY qid), work AS (SELECT qid, step1, coalesce(step2, 0) AS step2, n_clusters FROM nv LEFT JOIN s2 USING (qid), s1)"


def _cost_sql(rule: str) -> str:
    return f"SELECT * FROM ({_steps_sql(rule)}{_WORK} SELECT '{rule}' AS rule, round(avg(step1), 6) AS avg_step1, round(avg(step2), 6) AS avg_step2, round(avg(n_clusters), 6) AS avg_disk, round(avg(n_clusters) * 0.005 + avg(step2) * 4 * {WIDTH} / 128e6, 6) AS cost FROM work)"


_VANTAGE = f"""
WITH {_LIFTED}, vp AS (SELECT id AS vid, vec FROM v ORDER BY id LIMIT {POINTS}),
qf AS (SELECT qid, vid, round(list_distance(q.vec, vp.vec), 9) AS qd FROM q, vp),
nr AS (SELECT *, qd <= max(qd) FILTER (WHERE o <= {NEAREST}) OVER (PARTITION BY qid) AS near FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY qd) AS o FROM qf)),
xf AS (SELECT v.id, vid, round(list_distance(v.vec, vp.vec), 9) AS xd FROM v, vp),
ok AS (SELECT qid, xf.id FROM nr JOIN xf USING (vid) GROUP BY qid, xf.id HAVING bool_and(NOT near OR xd < 2 * qd))
SELECT qid, count(*) AS candidates, round(min(round(list_distance(q.vec, v.vec), 9)), 6) AS nearest FROM ok JOIN q USING (qid) JOIN v ON v.id = ok.id GROUP BY qid"""


def _tree_sql() -> str:
    parts = [f"WITH {V}, l0 AS (SELECT id, vec, '' AS cell FROM v)"]
    for i in range(DEPTH):
        parts.append(f"l{i + 1} AS (SELECT id, vec, cell || CASE WHEN vec[{i % WIDTH + 1}] <= quantile_cont(vec[{i % WIDTH + 1}], 0.5) OVER (PARTITION BY cell) THEN '0' ELSE '1' END AS cell FROM l{i})")
    return ", ".join(parts) + f" SELECT cell AS cell_id, count(*) AS n FROM l{DEPTH} GROUP BY cell"


ORACLE_SQL = {
    "radius_sweep": f"SELECT radius::DOUBLE AS radius, n AS queries, dist, true AS bounded FROM (VALUES {', '.join(f'({r})' for r in RADII)}) AS r(radius), (SELECT count(DISTINCT qid) AS n, round(sum(dist), 4) AS dist FROM ({_BRUTE.replace('round(dist, 6) AS dist', 'dist')}))",
    "cf_by_label": f"WITH {_CF} SELECT s.k AS cluster_id, cf.n, round(cf.ss, 5) AS ss, pos, round(s.ls, 5) AS ls FROM s JOIN cf USING (k)",
    "cf_incremental": f"WITH {_CF} SELECT k AS cluster_id, n, round(ss, 5) AS ss FROM cf",
    "stream_cluster_features": f"WITH {_CF} SELECT k AS cluster_id, n, round(ss, 5) AS ss FROM cf",
    "cf_radius_diameter": f"WITH {_CF}, r AS (SELECT k, sqrt(greatest(0, ss / n - l2 / (n * n))) AS radius FROM cf) SELECT k AS cluster_id, round(radius, 6) AS radius, round(sqrt(2) * radius, 6) AS diameter FROM r",
    "cf_merged": f"WITH {_AB} SELECT k AS cluster_id, n, round(sqrt(greatest(0, ss / n - l2 / (n * n))), 6) AS radius FROM mm",
    "cf_distances": f"WITH {_AB} SELECT k AS cluster_id, round(far * far, 5) AS d0, round(man, 5) AS d1, round(sqrt(greatest(0, s1 / n1 + s2 / n2 - 2 * ab / (n1 * n2))), 5) AS d2, "
    "round(sqrt(2) * sqrt(greatest(0, ss / n - l2 / (n * n))), 5) AS d3, round((ss - l2 / n) - (s1 - a2 / n1) - (s2 - b2 / n2), 5) AS d4 FROM mm",
    "cluster_assign": f"WITH {_ASSIGN} SELECT id, cluster_id, round(dist, 6) AS dist FROM mem",
    "cluster_summary": f"WITH {_ASSIGN} SELECT cluster_id, size, round(radius, 6) AS radius, round(nearest, 6) AS nearest FROM cl",
    "cluster_files": f"WITH {_ASSIGN} SELECT id, cluster_id, size, round(dist, 6) AS dist FROM mem JOIN cl USING (cluster_id) WHERE cluster_id = 3",
    "cluster_knn_exact": _BRUTE,
    "cluster_knn_memory": _steps_sql("memory") + _RANKED,
    "cluster_knn_disk": _steps_sql("disk") + _RANKED,
    "search_metrics": _steps_sql("exact") + _WORK + " SELECT * FROM work",
    "cluster_sweep": " UNION ALL ".join(f"SELECT * FROM ({_steps_sql('exact', f'any_value({n})')}{_WORK} SELECT CAST({n} AS BIGINT) AS clusters, round(avg(step1), 6) AS avg_step1, round(avg(step2), 6) AS avg_step2, round(avg(n_clusters), 6) AS avg_n_clusters FROM work)" for n in SWEEP),
    "birch_sums": f"WITH {V} SELECT CAST(count(*) AS BIGINT) AS n, round(sum(list_sum(vec)), 4) AS ls, round(sum(list_dot_product(vec, vec)), 4) AS ss, true AS below, count(DISTINCT id) AS labelled, count(*) AS labels, true AS few, true AS once FROM v",
    "search_cost": " UNION ALL ".join(_cost_sql(r) for r in ("exact", "memory", "disk")),
    "vantage_filter": _VANTAGE,
    "vantage_knn": _BRUTE,
    "cell_knn": _BRUTE,
    "shell_knn": _BRUTE,
    "vp_tree_knn": _BRUTE,
    "kd_cells": _tree_sql(),
}
