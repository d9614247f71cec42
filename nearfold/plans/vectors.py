"""Queries over feature vectors: scans, projections, scaling, aggregates, distances, exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import id_part, object_id
from ..functions.vectors import METRICS, dot, total
from ..operators import pairs
from ..operators.clusters import grid_cells
from ..operators.knn import knn
from ..operators.ml import accuracy_by_width, importance
from ..operators.quantiles import quantiles
from ..operators.scaling import Pca, min_max, sample, split, standardise
from ..operators.sums import column_sums, correlation, covariance, gram, merge_gram
from ..shared import new_path, staged
from ..sources.features import first_columns, reorder, write_partitioned
from ..sources.synthetic import blobs, uniform
from ..sources.text import bezier_points
from ..sources.versioned import VersionedTable
from .common import CENTRES, Q, V, X, long_form, targets, vectors

K = 5
HEAD = 1_000
SAMPLE = 100
WIDTH = 5


def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "label", F.size("vec").cast("long").alias("width"), F.round(F.sqrt(dot(F.col("vec"), F.col("vec"))), 6).alias("norm"))


def scan_partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "by_label")
    write_partitioned(vectors(spark, sf_dir), path, "label", order=("id",))
    return spark.read.parquet(path).filter(F.col("label").isin(2, 3, 4, 8)).select("id", F.col("label").cast("int").alias("label"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir).filter(F.col("id") == 7))


def object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field.tile.seq`` made and taken apart again."""
    rows = vectors(spark, sf_dir).select("id", object_id(F.col("label"), F.col("id") % 100, F.col("id")).alias("name"))
    return rows.select("id", "name", *[id_part(F.col("name"), i).cast("long").alias(n) for i, n in enumerate(("field", "tile", "seq"))])


def project_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(first_columns(vectors(spark, sf_dir), WIDTH))


def head_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).orderBy("id").limit(HEAD).select("id", "label")


def sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(vectors(spark, sf_dir), SAMPLE, "s1").select("id", "label")


def train_target_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rest = split(vectors(spark, sf_dir), SAMPLE, "s1")
    return chosen.select("id", F.lit(True).alias("is_target")).unionByName(rest.select("id", F.lit(False).alias("is_target")))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = column_sums(vectors(spark, sf_dir))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    return s.select("pos", "n", F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(standardise(vectors(spark, sf_dir).select("id", "vec")), digits=5)


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(min_max(vectors(spark, sf_dir).select("id", "vec"), -1.0, 1.0))


def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covariance(gram(vectors(spark, sf_dir))).select("i", "j", F.round("cov", 6).alias("cov"))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation(gram(vectors(spark, sf_dir))).select("i", "j", F.round("corr", 6).alias("corr"))


def gram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gram table per label, added up to that of all."""
    parts = gram(vectors(spark, sf_dir), "label").withColumn("grp", F.lit(0).cast("long"))
    return merge_gram(parts).select("i", "j", "n", *[F.round(c, 5).alias(c) for c in ("si", "sj", "sij")])


def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "vec")
    return long_form(Pca.fit(rows, WIDTH).transform(rows))


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variance of the standardised vectors and of their projection on all components: they agree."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    width = rows.select(F.size("vec")).first()
    if width is None:
        return spark.createDataFrame([], "total double, kept double")
    model = Pca.fit(rows, width[0])
    square = lambda r, n: r.select(dot(F.col("vec"), F.col("vec")).alias("s")).agg(F.round(F.avg("s"), 4).alias(n))
    return square(standardise(rows), "total").crossJoin(square(model.transform(rows), "kept"))  # one row each


def matrix_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label means (labels x components) times their transpose, in long form."""
    m = column_sums(vectors(spark, sf_dir), "label").select(F.col("grp").alias("i"), "pos", (F.col("s") / F.col("n")).alias("a"))
    t = m.select(F.col("i").alias("j"), "pos", F.col("a").alias("b"))
    return m.join(t, "pos").groupBy("i", "j").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("value"))


def array_row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.round(total(F.col("vec")), 6).alias("row_sum"))


def total_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).agg(F.round(F.sum(total(F.col("vec"))), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def square_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component-wise squared difference of each vector to the next id's."""
    v = vectors(spark, sf_dir).select("id", "vec")
    other = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    return long_form(v.join(other, "id").select("id", F.zip_with("vec", "b", lambda x, y: (x - y) * (x - y)).alias("vec")))


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        out = knn(targets(rows), rows, K, metric)
        return out.select("qid", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))

    return run


def adjacent_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered metric, between each vector and the next id's."""
    v = vectors(spark, sf_dir).select("id", "vec")
    other = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    both = v.join(other, "id")
    return both.select("id", *[F.round(f(F.col("vec"), F.col("b")), 6).alias(n) for n, f in METRICS.items()])


def pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_histogram(vectors(spark, sf_dir), 0.25)


def closest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.extreme_pair(vectors(spark, sf_dir)).select("a", "b", F.round("dist", 6).alias("dist"))


def farthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.extreme_pair(vectors(spark, sf_dir), closest=False).select("a", "b", F.round("dist", 6).alias("dist"))


def grid_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_cells(first_columns(vectors(spark, sf_dir), WIDTH), 0.1)


def synthetic_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many random vectors as the table has, by its ids."""
    return long_form(uniform(vectors(spark, sf_dir), WIDTH, 1))


def synthetic_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row a random point around the mean of its label's first two components."""
    rows = vectors(spark, sf_dir)
    means = rows.groupBy("label").agg(F.array(*[F.avg(F.col("vec")[j]) for j in range(2)]).alias("mean"))
    out = blobs(rows, means, 2, 1.5, 1)
    return out.select("id", "label", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each curve's observations as a path, every second one a control point, and points along it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), "ts", "event_id", F.floor(F.col("value") * 100).alias("y"))
    rows = events.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "y"))), lambda r: r["y"]).alias("y"))
    steps = F.transform(F.when(F.size("y") > 2, F.sequence(F.lit(1), F.size("y") - 2, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.lit("Q"), i, F.get("y", i), i + 1, F.get("y", i + 1)))
    out = bezier_points(rows.select("id", F.concat_ws(" ", F.lit("M 0"), F.get("y", F.lit(0)), F.concat_ws(" ", steps)).alias("path")), 11)
    return out.select("id", F.col("seg").cast("long").alias("seg"), F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept by union all, intersect and except of two label filters."""
    v = vectors(spark, sf_dir).select("id", "label")
    a, b = v.filter("label <= 5"), v.filter("label >= 4")
    named = [a.unionAll(b).withColumn("op", F.lit("union")), a.intersect(b).withColumn("op", F.lit("intersect")), a.join(b.select("id"), "id", "left_anti").withColumn("op", F.lit("except"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, changed by key, and read again."""
    v = vectors(spark, sf_dir).select("id", F.col("label").cast("long").alias("label"))
    changes = v.filter(F.col("label").isin(2, 3)).withColumn("label", F.col("label") + 10).unionByName(v.agg((F.max("id") + 1).alias("id"), F.lit(99).cast("long").alias("label")))
    table = VersionedTable(spark, new_path(spark, "versioned"), ["id"], 8)
    table.upsert(v)
    table.upsert(changes)
    table.vacuum()
    return table.read()


def symmetric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance matrix from its upper half."""
    upper = covariance(gram(vectors(spark, sf_dir))).filter("i <= j").select("i", "j", F.round("cov", 6).alias("cov"))
    return upper.unionByName(upper.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all components, in 20 equal bins from -1 to 1; bins 0 and 21 hold what lies outside."""
    values = vectors(spark, sf_dir).select(F.explode("vec").alias("x"))
    inside = F.floor((F.col("x") + 1) * 10) + 1
    return values.groupBy(F.when(F.col("x") < -1, 0).when(F.col("x") >= 1, 21).otherwise(inside).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 box heights), moments and outliers of the norms by label."""
    v = vectors(spark, sf_dir).select("label", F.round(F.sqrt(dot(F.col("vec"), F.col("vec"))), 9).alias("x"))
    v = staged(v, "norms")
    box = quantiles(v, "label", "x", [0.25, 0.5, 0.75]).select(F.col("grp").alias("label"), *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    box = box.join(v.groupBy("label").agg(F.var_pop("x").alias("moment2")), "label")
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("x").between(low, high), F.col("x"))
    out = v.join(box, "label").groupBy("label", "q1", "median", "q3", "moment2").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), (F.count(F.lit(1)) - F.count(inside)).alias("outliers"))
    return out.select("label", "outliers", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "moment2", "whisker_low", "whisker_high")])


def rf_importance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(vectors(spark, sf_dir))


def importance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to their ``WIDTH`` most important components."""
    rows = vectors(spark, sf_dir)
    order = [r.pos for r in importance(rows).orderBy("rank").limit(WIDTH).collect()]
    return long_form(reorder(rows, order).select("id", "vec"))


def cv_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    width = rows.select(F.size("vec")).first()
    return accuracy_by_width(rows, [w for w in (1, 2, 4, 8, 16, 32, 64) if width and w <= width[0]])


QUERIES = {f.__name__: f for f in (
    scan_vectors, scan_partition_filter, point_lookup, object_ids, project_first_n, head_by_id, sample_fixed, train_target_split, column_stats,
    standardize, minmax_scale, covariance_matrix, correlation_matrix, gram_merge, pca_project, pca_variance, matrix_multiply, array_row_sum,
    total_sum, square_difference, adjacent_distances, pair_histogram, closest_pair, farthest_pair, grid_cell_counts, synthetic_uniform,
    synthetic_blobs, path_points, set_operations, upsert_rows, symmetric_matrix, histogram, boxplot_stats, rf_importance_order,
    importance_projection, cv_accuracy,
)} | {"knn_brute": _knn("euclidean"), "knn_manhattan": _knn("manhattan"), "knn_sq_euclidean": _knn("sq_euclidean")}

_DIST = {
    "euclidean": "list_distance({a}, {b})",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
    "sq_euclidean": "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
}


def _knn_sql(metric: str) -> str:
    d = _DIST[metric].format(a="q.vec", b="v.vec")
    return f"""
WITH {Q}, d AS (SELECT qid, v.id, round({d}, 9) AS dist FROM q JOIN v ON v.id <> q.qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {K}"""


_PAIRS = f"WITH {V}, d AS (SELECT l.id AS a, r.id AS b, round(list_distance(l.vec, r.vec), 9) AS dist FROM v l JOIN v r ON l.id < r.id)"
_COV = "cv AS (SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.val, b.val), 6) AS cov FROM x a JOIN x b ON a.id = b.id GROUP BY a.pos, b.pos)"
_U = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT) / 281474976710656.0"
_SIZES = "SELECT label, id, round(sqrt(list_dot_product(vec, vec)), 9) AS x FROM v"

ORACLE_SQL = {
    "scan_vectors": f"WITH {V} SELECT id, label, CAST(len(vec) AS BIGINT) AS width, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM v",
    "scan_partition_filter": f"WITH {V} SELECT id, label FROM v WHERE label IN (2, 3, 4, 8)",
    "point_lookup": f"WITH {X} SELECT id, pos, round(val, 6) AS value FROM x WHERE id = 7",
    "object_ids": f"WITH {V} SELECT id, label || '.' || (id % 100) || '.' || id AS name, CAST(label AS BIGINT) AS field, id % 100 AS tile, id AS seq FROM v",
    "project_first_n": f"WITH {X} SELECT id, pos, round(val, 6) AS value FROM x WHERE pos < {WIDTH}",
    "head_by_id": f"WITH {V} SELECT id, label FROM v ORDER BY id LIMIT {HEAD}",
    "sample_fixed": f"WITH {V} SELECT id, label FROM v ORDER BY md5(id || 's1'), id LIMIT {SAMPLE}",
    "train_target_split": f"WITH {V} SELECT id, row_number() OVER (ORDER BY md5(id || 's1'), id) <= {SAMPLE} AS is_target FROM v",
    "column_stats": f"WITH {X} SELECT pos, count(*) AS n, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, round(min(val), 6) AS low, round(max(val), 6) AS high FROM x GROUP BY pos",
    "standardize": f"WITH {X}, s AS (SELECT pos, avg(val) AS m, stddev_pop(val) AS s FROM x GROUP BY pos) SELECT id, pos, round(CASE WHEN s = 0 THEN 0 ELSE (val - m) / s END, 5) AS value FROM x JOIN s USING (pos)",
    "minmax_scale": f"WITH {X}, s AS (SELECT pos, min(val) AS lo, max(val) AS hi FROM x GROUP BY pos) SELECT id, pos, round(CASE WHEN hi = lo THEN -1 ELSE (val - lo) / (hi - lo) * 2 - 1 END, 6) AS value FROM x JOIN s USING (pos)",
    "covariance_matrix": f"WITH {X}, {_COV} SELECT i, j, cov FROM cv",
    "symmetric_matrix": f"WITH {X}, {_COV} SELECT i, j, cov FROM cv",
    "correlation_matrix": f"WITH {X} SELECT a.pos AS i, b.pos AS j, round(corr(a.val, b.val), 6) AS corr FROM x a JOIN x b ON a.id = b.id GROUP BY a.pos, b.pos",
    "gram_merge": f"WITH {X} SELECT a.pos AS i, b.pos AS j, count(*) AS n, round(sum(a.val), 5) AS si, round(sum(b.val), 5) AS sj, round(sum(a.val * b.val), 5) AS sij FROM x a JOIN x b ON a.id = b.id GROUP BY a.pos, b.pos",
    "pca_variance": f"WITH {X}, s AS (SELECT pos, avg(val) AS m, stddev_pop(val) AS s FROM x GROUP BY pos), z AS (SELECT id, sum(CASE WHEN s = 0 THEN 0 ELSE pow((val - m) / s, 2) END) AS e FROM x JOIN s USING (pos) GROUP BY id) SELECT round(avg(e), 4) AS total, round(avg(e), 4) AS kept FROM z",
    "matrix_multiply": f"WITH {CENTRES} SELECT CAST(a.label AS BIGINT) AS i, CAST(b.label AS BIGINT) AS j, round(sum(a.a * b.a), 6) AS value FROM m a JOIN m b USING (pos) GROUP BY a.label, b.label",
    "array_row_sum": f"WITH {V} SELECT id, round(list_sum(vec), 6) AS row_sum FROM v",
    "total_sum": f"WITH {V} SELECT round(sum(list_sum(vec)), 4) AS total, count(*) AS n FROM v",
    "square_difference": f"WITH {X} SELECT a.id, a.pos, round((a.val - b.val) * (a.val - b.val), 6) AS value FROM x a JOIN x b ON b.id = a.id + 1 AND b.pos = a.pos",
    "adjacent_distances": f"WITH {V} SELECT l.id, " + ", ".join(f"round({d.format(a='l.vec', b='r.vec')}, 6) AS {n}" for n, d in _DIST.items()) + " FROM v l JOIN v r ON r.id = l.id + 1",
    "pair_histogram": _PAIRS + " SELECT CAST(floor(dist / 0.25) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY 1",
    "closest_pair": _PAIRS + " SELECT a, b, round(dist, 6) AS dist FROM (SELECT * FROM d ORDER BY d.dist, a, b LIMIT 1)",
    "farthest_pair": _PAIRS + " SELECT a, b, round(dist, 6) AS dist FROM (SELECT * FROM d ORDER BY d.dist DESC, a, b LIMIT 1)",
    "grid_cell_counts": f"WITH {V} SELECT array_to_string(list_transform(vec[1:{WIDTH}], lambda e: CAST(CAST(floor(e / 0.2) AS BIGINT) AS VARCHAR)), ',') AS cell, count(*) AS n FROM v GROUP BY 1",
    "synthetic_uniform": f"SELECT i AS id, CAST(j AS BIGINT) AS pos, round({_U.format("i || ':' || j || ':1'")}, 6) AS value FROM (SELECT vec_id AS i FROM embeddings), range({WIDTH}) b(j)",
    "synthetic_blobs": f"WITH {V}, m AS (SELECT label, avg(vec[1]) AS m0, avg(vec[2]) AS m1 FROM v GROUP BY label) SELECT id, label, "
    + ", ".join(
        f"round(m{j} + 1.5 * sqrt(-2 * ln(1 - {_U.format(f"id || ':{j}:r:1'")})) * cos(2 * pi() * {_U.format(f"id || ':{j}:a:1'")}), 6) AS {n}" for j, n in enumerate("xy")
    )
    + " FROM v JOIN m USING (label)",
    "path_points": "WITH e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, floor(value * 100) AS y FROM events), "
    "s AS (SELECT a.id, a.x // 2 + 1 AS seg, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2 FROM e a JOIN e b ON b.id = a.id AND b.x = a.x + 1 JOIN e c ON c.id = a.id AND c.x = a.x + 2 WHERE a.x % 2 = 0), "
    "p AS (SELECT *, i / 10.0 AS t FROM s, range(11) r(i)) "
    "SELECT CAST(id AS BIGINT) AS id, CAST(seg AS BIGINT) AS seg, i, "
    + ", ".join(f"round(CAST((1 - t) * (1 - t) * {a}0 + 2 * (1 - t) * t * {a}1 + t * t * {a}2 AS DOUBLE), 6) AS {a}" for a in "xy")
    + " FROM p",
    "set_operations": f"WITH {V} SELECT id, label, 'union' AS op FROM v WHERE label <= 5 UNION ALL SELECT id, label, 'union' FROM v WHERE label >= 4 UNION ALL SELECT id, label, 'intersect' FROM v WHERE label BETWEEN 4 AND 5 UNION ALL SELECT id, label, 'except' FROM v WHERE label < 4",
    "upsert_rows": f"WITH {V} SELECT id, CAST(CASE WHEN label IN (2, 3) THEN label + 10 ELSE label END AS BIGINT) AS label FROM v UNION ALL SELECT max(id) + 1, 99 FROM v",
    "histogram": f"WITH {X} SELECT CAST(CASE WHEN val < -1 THEN 0 WHEN val >= 1 THEN 21 ELSE floor((val + 1) * 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1",
    "boxplot_stats": f"WITH {V}, z AS ({_SIZES}), b AS (SELECT label, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, var_pop(x) AS moment2 FROM z GROUP BY label), "
    "k AS (SELECT z.*, q1, median, q3, moment2, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM z JOIN b USING (label)) "
    "SELECT label, count(*) FILTER (WHERE NOT inside) AS outliers, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(moment2), 6) AS moment2, "
    "round(min(x) FILTER (WHERE inside), 6) AS whisker_low, round(max(x) FILTER (WHERE inside), 6) AS whisker_high FROM k GROUP BY label",
} | {n: _knn_sql(m) for n, m in (("knn_brute", "euclidean"), ("knn_manhattan", "manhattan"), ("knn_sq_euclidean", "sq_euclidean"))}
