"""Distances between array columns and the algebra of cluster features, as Column expressions.

A cluster feature is the triple (n, ls, ss): count, linear sum and sum of squared norms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """An array column as array<double>."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def sq_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


#: Metric by name; callers may add their own builder.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "sq_euclidean": sq_euclidean, "manhattan": manhattan}


def centroid(cf: Column) -> Column:
    return F.transform(cf["ls"], lambda x: x / cf["n"])


def cf_merge(a: Column, b: Column) -> Column:
    return F.struct((a["n"] + b["n"]).alias("n"), F.zip_with(a["ls"], b["ls"], lambda x, y: x + y).alias("ls"), (a["ss"] + b["ss"]).alias("ss"))


def cf_radius(cf: Column) -> Column:
    """Root mean squared distance of the members to the centroid."""
    return F.sqrt(F.greatest(F.lit(0.0), cf["ss"] / cf["n"] - dot(cf["ls"], cf["ls"]) / (cf["n"] * cf["n"])))


def cf_diameter(cf: Column) -> Column:
    return F.sqrt(F.lit(2.0)) * cf_radius(cf)


def cf_d0(a: Column, b: Column) -> Column:
    """Squared distance of the centroids."""
    return sq_euclidean(centroid(a), centroid(b))


def cf_d1(a: Column, b: Column) -> Column:
    """Manhattan distance of the centroids."""
    return manhattan(centroid(a), centroid(b))


def cf_d2(a: Column, b: Column) -> Column:
    """Root of the mean squared distance between members of the two."""
    return F.sqrt(F.greatest(F.lit(0.0), a["ss"] / a["n"] + b["ss"] / b["n"] - 2 * dot(a["ls"], b["ls"]) / (a["n"] * b["n"])))


def cf_d3(a: Column, b: Column) -> Column:
    """Diameter of the merged cluster."""
    return cf_diameter(cf_merge(a, b))


def cf_d4(a: Column, b: Column) -> Column:
    """Increase of the sum of squared deviations by merging."""
    within = lambda c: c["ss"] - dot(c["ls"], c["ls"]) / c["n"]
    return within(cf_merge(a, b)) - within(a) - within(b)


CF_DISTANCES = {"d0": cf_d0, "d1": cf_d1, "d2": cf_d2, "d3": cf_d3, "d4": cf_d4}


def standardised(v: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std by component; 0 where std is 0."""
    z = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(z, std, lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s))


def rescaled(v: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Min-max scaling by component; ``to_low`` where a component is constant."""
    z = F.zip_with(v, low, lambda x, m: x - m)
    span = F.zip_with(high, low, lambda h, m: h - m)
    return F.zip_with(z, span, lambda x, s: F.when(s == 0, F.lit(to_low)).otherwise(x / s * (to_high - to_low) + to_low))


def chebyshev_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Greatest difference by component between the rows of two matrices: a metric as a callable."""
    return np.abs(a[:, None, :] - b[None, :, :]).max(2)
