"""Small text formats: density trees and quadratic paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.curves import bezier

#: A line of a density tree: axis, side, value and, at a leaf, the density.
TREE_LINE = r"Var\.\s*([0-9]+)\s*(<=|>)\s*([-+0-9.eE]+)\s*:?\s*(?:f\(x\)=\s*([-+0-9.eE]+))?"


def read_tree(spark: SparkSession, path: str) -> dict:
    """The tree in a text file: each split stands as two lines, one a side, children behind their line."""
    found = spark.read.text(path, wholetext=True).first()
    return parse_tree((found.value if found else "").splitlines())


def parse_tree(lines: list[str]) -> dict:
    """``{"axis", "value", "left", "right"}`` down to leaves ``{"density"}``; left is ``<=``."""
    import re

    rows = [m.groups() for m in map(re.compile(TREE_LINE).search, lines) if m]
    root: dict = {}
    open_splits: list[dict] = []  # splits that still wait for their other side
    at = root
    for axis, side, value, density in rows:
        key = int(axis), float(value)
        if open_splits and (open_splits[-1]["axis"], open_splits[-1]["value"]) == key and ("left" if side == "<=" else "right") not in open_splits[-1]:
            node = open_splits.pop()
        else:
            node = at
            node |= {"axis": key[0], "value": key[1]}
            open_splits.append(node)
        at = node["left" if side == "<=" else "right"] = {}
        if density is not None:
            at["density"] = float(density)
    return root


def grow(tree: dict, path: str, axis: int, value: float) -> dict:
    """The tree with its leaf at ``path`` ('0' left, '1' right) split by a rule; both halves keep the leaf's density."""
    if not path:
        if "axis" in tree:
            raise ValueError("no leaf at this path")
        return {"axis": axis, "value": float(value), "left": dict(tree), "right": dict(tree)}
    side = "right" if path[0] == "1" else "left"
    return tree | {side: grow(tree[side], path[1:], axis, value)}


def path_points(path: Column | str) -> Column:
    """array<struct<cmd, nums array<double>>> of a path of M and Q commands."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.regexp_extract_all(p, F.lit(r"([A-Za-z][^A-Za-z]*)"))
    numbers = lambda s: F.transform(F.filter(F.split(F.trim(F.substring(s, F.lit(2), F.length(s))), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("double"))
    return F.transform(parts, lambda s: F.struct(F.substring(s, 1, 1).alias("cmd"), numbers(s).alias("nums")))


def bezier_points(rows: DataFrame, resolution: int) -> DataFrame:
    """(id, seg, i, x, y): ``resolution`` points on each quadratic segment of ``path``, t = i / (resolution - 1)."""
    steps = rows.select("id", F.posexplode(path_points("path")).alias("seg", "c"))
    n = F.size("c.nums")
    end = F.struct(F.col("c.nums")[n - 2].alias("x"), F.col("c.nums")[n - 1].alias("y"))
    steps = steps.withColumn("from", F.lag(end).over(W.partitionBy("id").orderBy("seg"))).filter(F.col("c.cmd") == "Q")
    t = F.col("i") / max(1, resolution - 1)
    points = steps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
    of = lambda axis, j: bezier(t, F.col("from")[axis], F.col("c.nums")[j], F.col("c.nums")[j + 2])
    return points.select("id", "seg", "i", of("x", 0).alias("x"), of("y", 1).alias("y"))
