"""Feature tables: CSV tiles named by field and tile, Parquet partitioned by field and tile, row counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 64 feature columns of a tile, in order (fixed values).
FEATURES = (
    "Amplitude AndersonDarling Autocor_length Beyond1Std CAR_mean CAR_sigma CAR_tau Color Con Eta_color Eta_e "
    "FluxPercentileRatioMid20 FluxPercentileRatioMid35 FluxPercentileRatioMid50 FluxPercentileRatioMid65 FluxPercentileRatioMid80 "
    "Freq1_harmonics_amplitude_0 Freq1_harmonics_amplitude_1 Freq1_harmonics_amplitude_2 Freq1_harmonics_amplitude_3 "
    "Freq1_harmonics_rel_phase_0 Freq1_harmonics_rel_phase_1 Freq1_harmonics_rel_phase_2 Freq1_harmonics_rel_phase_3 "
    "Freq2_harmonics_amplitude_0 Freq2_harmonics_amplitude_1 Freq2_harmonics_amplitude_2 Freq2_harmonics_amplitude_3 "
    "Freq2_harmonics_rel_phase_0 Freq2_harmonics_rel_phase_1 Freq2_harmonics_rel_phase_2 Freq2_harmonics_rel_phase_3 "
    "Freq3_harmonics_amplitude_0 Freq3_harmonics_amplitude_1 Freq3_harmonics_amplitude_2 Freq3_harmonics_amplitude_3 "
    "Freq3_harmonics_rel_phase_0 Freq3_harmonics_rel_phase_1 Freq3_harmonics_rel_phase_2 Freq3_harmonics_rel_phase_3 "
    "LinearTrend MaxSlope Mean Meanvariance MedianAbsDev MedianBRP PairSlopeTrend PercentAmplitude PercentDifferenceFluxPercentile "
    "PeriodLS Period_fit Psi_CS Psi_eta Q31 Q31_color Rcs Skew SlottedA_length SmallKurtosis Std StetsonJ StetsonK StetsonK_AC StetsonL"
).split()


def read_tiles(spark: SparkSession, folder: str, field: str | int = "*", tile: str | int = "*", columns: list[str] | None = None) -> DataFrame:
    """(id, columns..., field, tile) of the files ``F_<field>_<tile>.csv``: a header, the id first.

    Field and tile narrow the listing, so other files are never opened.
    """
    names = list(columns or FEATURES)
    schema = ", ".join(["id string", *(f"`{c}` double" for c in names)])
    rows = spark.read.schema(schema).csv(f"{folder}/F_{field}_{tile}.csv", header=True, enforceSchema=True)
    part = lambda i: F.regexp_extract(F.input_file_name(), r"F_([0-9]+)_([0-9]+)\.csv", i).cast("int")
    return rows.withColumn("field", part(1)).withColumn("tile", part(2))


def read_tile_folders(spark: SparkSession, path: str, field: str | int | None = None, tile: str | int | None = None, columns: list[str] | None = None) -> DataFrame:
    """(id, columns..., field, tile) of tiles as ``write_tiles`` lays them out; other folders are never listed."""
    names = list(columns or FEATURES)
    schema = ", ".join(["id string", *(f"`{c}` double" for c in names), "field int", "tile int"])
    rows = spark.read.schema(schema).option("header", "true").csv(path)
    for c, value in (("field", field), ("tile", tile)):
        rows = rows if value is None else rows.filter(F.col(c) == int(value))
    return rows


def first_tiles(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` tiles, by field and tile; other files are not read."""
    found = (re.search(r"field=(\d+)/tile=(\d+)/", f) for f in rows.inputFiles())
    tiles = sorted({(int(m[1]), int(m[2])) for m in found if m})[:n]
    return rows.filter(reduce(Column.__or__, [(F.col("field") == f) & (F.col("tile") == t) for f, t in tiles], F.lit(False)))


def write_targets(queries: DataFrame, path: str) -> None:
    """Targets (qid, vec) as CSV: the id, then a column per component."""
    width = queries.select(F.max(F.size("vec"))).first()[0] or 0
    queries.select("qid", *[F.col("vec")[i].alias(str(i)) for i in range(width)]).write.mode("overwrite").csv(path, header=True)


def read_targets(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """(qid, vec) of CSV files with a header, the id first."""
    names = spark.read.option("header", "true").csv(path).columns
    schema = ", ".join([f"qid {id_type}", *(f"`{c}` double" for c in names[1:])])
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(path)
    return as_vectors(rows, names[1:], "qid").withColumnRenamed("id", "qid")


def as_vectors(rows: DataFrame, columns: list[str], identifier: str = "id") -> DataFrame:
    """(id, vec): the columns as one array of doubles."""
    return rows.select(F.col(identifier).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))


def first_columns(rows: DataFrame, n: int) -> DataFrame:
    """``vec`` cut to its first ``n`` components."""
    return rows.withColumn("vec", F.slice("vec", 1, n))


def reorder(rows: DataFrame, order: list[int]) -> DataFrame:
    """``vec`` with its components in this order."""
    return rows.withColumn("vec", F.array(*[F.col("vec")[i] for i in order]))


def padded(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All feature columns by name; those a one-band curve lacks are 0."""
    have = set(rows.columns)
    names = columns or FEATURES
    of: list[Column] = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in names]
    return rows.select("id", *of)


def write_partitioned(rows: DataFrame, path: str, *by: str, order: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet with a folder per value of ``by``, rows of a file in this order.

    Rows are rebalanced on the partition columns, so a large value is split over several files.
    """
    dealt = rows.hint("rebalance", *by)
    dealt.sortWithinPartitions(*by, *order).write.mode(mode).partitionBy(*by).parquet(path)


def write_tiles(rows: DataFrame, path: str) -> None:
    """CSV tiles in folders by field and tile."""
    rows.hint("rebalance", "field", "tile").write.mode("overwrite").partitionBy("field", "tile").csv(path, header=True)


def write_clusters(members: DataFrame, clusters: DataFrame, path: str) -> None:
    """Members (cluster_id, id, vec, dist) by cluster, ascending in distance, and the table of clusters."""
    write_partitioned(members, f"{path}/members", "cluster_id", order=("dist",))
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) as written; filters on cluster_id read only those folders."""
    return spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/clusters")
