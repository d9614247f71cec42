"""Queries that write what the engine writes, read it back, and use it: tiles, curves, trees, targets, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import object_id
from ..functions.vectors import METRICS, chebyshev_block, dot
from ..operators.curves import features
from ..operators.index import CellIndex
from ..operators.knn import knn
from ..operators.scaling import IncrementalPca, Pca, standardise
from ..operators.sums import column_sums
from ..operators.trees import located
from ..shared import new_path, staged
from ..sources.features import FEATURES, as_vectors, first_columns, first_tiles, padded, read_targets, read_tile_folders, write_targets, write_tiles
from ..sources.text import read_tree
from ..sources.tiles import read_curve as tile_curve
from ..sources.tiles import read_tar_tiles, write_tar_tiles
from .common import C, Q, V, X, curves, targets, vectors
from .curves import _FEATURES as _LC
from .curves import NUDGE, _nudged
from .search import _BRUTE, K, _lifted, _result

TREE = ["Var. 0 > 0.05", "|\tVar. 3 > -0.02: f(x)=1.5", "|\tVar. 3 <= -0.02: f(x)=0.25", "Var. 0 <= 0.05", "|\tVar. 7 > 0: f(x)=2e-1", "|\tVar. 7 <= 0: f(x)=3"]
TILES, WIDTH, CAP = 3, 5, 7
ZERO = ("Color", "Q31_color", "StetsonJ", "StetsonL")  # what one band lacks
BAD = ("1.1.bad", "R")


def _tiles(rows: DataFrame) -> DataFrame:
    """Vectors as feature tiles: id ``field.tile.seq``, a column per feature, field and tile."""
    named = [F.col("vec")[i].alias(c) for i, c in enumerate(FEATURES)]
    field, tile = F.col("label"), F.col("id") % TILES
    return rows.select(object_id(field, tile, F.col("id")).alias("id"), *named, field.alias("field"), tile.cast("int").alias("tile"))


def tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV tiles written by field and tile; one field read back."""
    path = new_path(spark, "tiles")
    write_tiles(_tiles(vectors(spark, sf_dir)), path)
    back = read_tile_folders(spark, path, field=3)
    return back.select("id", "field", "tile", *[F.round(c, 6).alias(c) for c in (FEATURES[0], FEATURES[30], FEATURES[63])])


def tile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles read back as vectors, with the sum of each."""
    path = new_path(spark, "tiles")
    write_tiles(_tiles(vectors(spark, sf_dir)), path)
    rows = as_vectors(read_tile_folders(spark, path), FEATURES)
    return rows.select("id", F.round(dot(F.col("vec"), F.col("vec")), 6).alias("square"))


def capped_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tiles only, with the columns in another order; the cap is the feature."""
    path = new_path(spark, "tiles")
    write_tiles(_tiles(vectors(spark, sf_dir)), path)
    rows = as_vectors(first_tiles(read_tile_folders(spark, path), CAP), FEATURES[::-1])
    return rows.select("id", F.round(F.col("vec")[0], 6).alias("first"))


def pca_tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors projected on all components, written as CSV tiles and read back: squares are those of the scaled vectors."""
    rows, path = vectors(spark, sf_dir), new_path(spark, "pca_tiles")
    out = Pca.fit(rows.select("id", "vec"), len(FEATURES)).transform(rows)
    write_tiles(_tiles(out), path)
    back = as_vectors(read_tile_folders(spark, path), FEATURES)
    return back.select("id", F.round(dot(F.col("vec"), F.col("vec")), 4).alias("square"))


def _steps(rows: DataFrame) -> DataFrame:
    """Distance of each projected vector to the next id's: free of the signs of components."""
    other = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    return rows.join(other, "id").select("id", F.round(METRICS["euclidean"](F.col("vec"), F.col("b")), 4).alias("dist"))


def pca_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components as a table, written, read back and applied."""
    rows, path = vectors(spark, sf_dir).select("id", "vec"), new_path(spark, "pca")
    Pca.fit(rows, len(FEATURES)).save(spark, path)
    return _steps(Pca.load(spark, path).transform(rows))


def pca_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a model that got one label's rows after the other, saved and loaded in between."""
    rows, model, path = vectors(spark, sf_dir), IncrementalPca(), new_path(spark, "ipca")
    for i, part in enumerate([F.col("label") < 3, F.col("label").between(3, 6), F.col("label") > 6]):
        model.add(rows.filter(part).select("id", "vec")).save(spark, f"{path}/{i}")
        model = IncrementalPca.load(spark, f"{path}/{i}")
    return _steps(model.pca(len(FEATURES)).transform(rows.select("id", "vec")))


def target_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets written as CSV and read back, searched for in the first components."""
    rows, path = first_columns(vectors(spark, sf_dir), WIDTH), new_path(spark, "targets")
    write_targets(targets(rows), path)
    out = knn(read_targets(spark, path, "long"), rows, K)
    return out.select("qid", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def _written(rows: DataFrame) -> str:
    """The path of curves written as tar tiles."""
    path = new_path(rows.sparkSession, "tiles")
    write_tar_tiles(rows, path)
    return path


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(spark, sf_dir).select(F.format_string("1.%d.%d", F.col("id") % TILES, "id").alias("id"), "band", (F.col("id") % TILES).alias("tile"), "t", "mag", F.lit(0.5).alias("err"))


def curve_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves written as tiles of text files in tar form and read again by ranges: counts and sums by curve and band."""
    back = read_tar_tiles(spark, _written(_tiled(spark, sf_dir)))
    return back.groupBy("id", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mag"), 4).alias("mag"), F.round(F.min("t"), 6).alias("t"), F.round(F.sum("err"), 4).alias("err"))


def curve_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve that can't be read gives a row that says so, and stops no other."""
    bad = spark.createDataFrame([(BAD[0], BAD[1], 1, 0.0, None, 1.0)], "id string, band string, tile long, t double, mag double, err double")
    back = read_tar_tiles(spark, _written(_tiled(spark, sf_dir).unionByName(bad)))
    return back.groupBy(F.col("problem").isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("curves"))


def read_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve's observations in one band, looked up in the tiles by its headers: the longest curve's, in its first band."""
    rows = staged(_tiled(spark, sf_dir), "curves")
    path = _written(rows)
    first = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("band").alias("band")).orderBy(F.desc("n"), "id").first()
    out = tile_curve(spark, path, *((first["id"], first["band"]) if first else ("", "")))
    return out.select("id", "band", F.round("t", 6).alias("t"), F.round("mag", 6).alias("mag"))


def _read_tree(spark: SparkSession) -> dict:
    path = new_path(spark, "tree")
    spark.createDataFrame([(i, x) for i, x in enumerate(TREE)], "i int, value string").coalesce(1).orderBy("i").select("value").write.text(path)
    return read_tree(spark, path)


def density_tree_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by cell of a density tree read from its text file."""
    rows = vectors(spark, sf_dir)
    return located(rows, _read_tree(spark)).groupBy(F.col("cell").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))


def density_tree_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _result(CellIndex(rows, _read_tree(spark)).knn(_lifted(rows), K))


def knn_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by a metric given as a Python function over blocks."""
    rows = vectors(spark, sf_dir)
    out = knn(targets(rows), rows, K, chebyshev_block)
    return out.select("qid", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def knn_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of each neighbour: observations and mean magnitude."""
    rows = vectors(spark, sf_dir)
    near = knn(targets(rows), rows, K).select("qid", "id", F.col("rank").cast("long").alias("rank"))
    return near.join(curves(spark, sf_dir).select("id", "mag"), "id").groupBy("qid", "rank", "id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mag"), 6).alias("mag"))


def label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).agg(F.count_distinct("label").alias("labels"), F.count(F.lit(1)).alias("n"))


def array_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy, a constant and a doubled vector, by their sums."""
    v, total = vectors(spark, sf_dir), lambda f: F.round(F.aggregate(F.transform("vec", f), F.lit(0.0), lambda a, x: a + x), 6)
    return v.select("id", total(lambda x: x).alias("copied"), total(lambda _: F.lit(1.0)).alias("filled"), total(lambda x: x * 2).alias("doubled"))


def padded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 columns by name of one-band features; those that one band lacks are 0."""
    out = padded(features(curves(spark, sf_dir)))
    assert out.columns == ["id", *FEATURES]
    return out.select("id", *[F.round(F.col(c) + (0.0 if c in ZERO else NUDGE), 5).alias(c) for c in ("Amplitude", "Color", "Mean", "Q31_color", "Skew", "StetsonJ", "StetsonL", "Std")])


def standardized_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of every component after scaling."""
    s = column_sums(standardise(vectors(spark, sf_dir).select("id", "vec")))
    return s.select("pos", F.abs(F.round(F.col("s") / F.col("n"), 6)).alias("mean"), F.round(F.sqrt(F.col("ss") / F.col("n")), 6).alias("std"))


QUERIES = {f.__name__: f for f in (
    tile_files, tile_vectors, capped_tiles, pca_tile_files, pca_model, pca_incremental, target_files, curve_tiles, curve_problems, read_curve, density_tree_cells, density_tree_knn,
    knn_callable, knn_curves, label_count, array_fill, padded_features, standardized_means,
)}

_SCALED = f"{X}, s AS (SELECT pos, avg(val) AS m, stddev_pop(val) AS s FROM x GROUP BY pos), z AS (SELECT id, list(CASE WHEN s = 0 THEN 0 ELSE (val - m) / s END ORDER BY pos) AS z FROM x JOIN s USING (pos) GROUP BY id)"
_STEPS = f"WITH {_SCALED} SELECT a.id, round(list_distance(a.z, b.z), 4) AS dist FROM z a JOIN z b ON b.id = a.id + 1"
_NAME = f"label || '.' || (id % {TILES}) || '.' || id AS id"
_CURVE = f"'1.' || (id % {TILES}) || '.' || id AS id"
_NEAR = "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)"

ORACLE_SQL = {
    "tile_files": f"WITH {V} SELECT {_NAME}, label AS field, CAST(id % {TILES} AS INTEGER) AS tile, round(vec[1], 6) AS {FEATURES[0]}, round(vec[31], 6) AS {FEATURES[30]}, round(vec[64], 6) AS {FEATURES[63]} FROM v WHERE label = 3",
    "tile_vectors": f"WITH {V} SELECT {_NAME}, round(list_dot_product(vec, vec), 6) AS square FROM v",
    "capped_tiles": f"WITH {V}, t AS (SELECT label, id % {TILES} AS tile FROM v GROUP BY 1, 2 ORDER BY 1, 2 LIMIT {CAP}) SELECT {_NAME.replace('label', 'v.label', 1)}, round(vec[64], 6) AS first FROM v JOIN t ON t.label = v.label AND t.tile = v.id % {TILES}",
    "pca_tile_files": f"WITH {_SCALED} SELECT label || '.' || (z.id % {TILES}) || '.' || z.id AS id, round(list_dot_product(z, z), 4) AS square FROM z JOIN v ON v.id = z.id",
    "pca_model": _STEPS,
    "pca_incremental": _STEPS,
    "target_files": f"WITH {Q}, d AS (SELECT qid, v.id, round(list_distance(q.vec[1:{WIDTH}], v.vec[1:{WIDTH}]), 9) AS dist FROM q JOIN v ON v.id <> q.qid), {_NEAR} SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {K}",
    "curve_tiles": f"WITH {C} SELECT {_CURVE}, band, count(*) AS n, round(sum(mag), 4) AS mag, round(min(t), 6) AS t, round(count(*) * 0.5, 4)::DOUBLE AS err FROM c GROUP BY c.id, band",
    "curve_problems": f"WITH {C} SELECT false AS bad, count(*) AS n, count(DISTINCT id) AS curves FROM c UNION ALL SELECT true, 1, 1",
    "read_curve": f"WITH {C}, k AS (SELECT {_CURVE}, band, t, mag FROM c), o AS (SELECT id, min(band) AS band FROM k GROUP BY id ORDER BY count(*) DESC, id LIMIT 1) SELECT id, band, round(t, 6) AS t, round(mag, 6) AS mag FROM k SEMI JOIN o USING (id, band)",
    "density_tree_cells": f"WITH {V} SELECT CASE WHEN vec[1] <= 0.05 THEN CASE WHEN vec[8] <= 0 THEN '00' ELSE '01' END ELSE CASE WHEN vec[4] <= -0.02 THEN '10' ELSE '11' END END AS cell_id, count(*) AS n FROM v GROUP BY 1",
    "density_tree_knn": _BRUTE,
    "knn_callable": f"WITH {Q}, d AS (SELECT qid, v.id, round(list_max(list_transform(list_zip(q.vec, v.vec), lambda p: abs(p[1] - p[2]))), 9) AS dist FROM q JOIN v ON v.id <> q.qid), {_NEAR} SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {K}",
    "knn_curves": f"WITH {Q}, {C}, d AS (SELECT qid, v.id, round(list_distance(q.vec, v.vec), 9) AS dist FROM q JOIN v ON v.id <> q.qid), {_NEAR} SELECT qid, rank, r.id, count(*) AS n, round(avg(mag), 6) AS mag FROM r JOIN c ON c.id = r.id WHERE rank <= {K} GROUP BY qid, rank, r.id",
    "label_count": "SELECT count(DISTINCT label) AS labels, count(*) AS n FROM embeddings",
    "array_fill": f"WITH {V} SELECT id, round(list_sum(vec), 6) AS copied, round(CAST(len(vec) AS DOUBLE), 6) AS filled, round(list_sum(list_transform(vec, lambda e: e * 2)), 6) AS doubled FROM v",
    "padded_features": f"SELECT id, coalesce(Amplitude, 0) AS Amplitude, CAST(0 AS DOUBLE) AS Color, coalesce(Mean, 0) AS Mean, CAST(0 AS DOUBLE) AS Q31_color, coalesce(Skew, 0) AS Skew, CAST(0 AS DOUBLE) AS StetsonJ, CAST(0 AS DOUBLE) AS StetsonL, coalesce(Std, 0) AS Std FROM ({_nudged(_LC)})",
    "standardized_means": f"WITH {X}, s AS (SELECT pos, stddev_pop(val) AS s FROM x GROUP BY pos) SELECT pos, CAST(0 AS DOUBLE) AS mean, CASE WHEN s = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS std FROM s",
}
