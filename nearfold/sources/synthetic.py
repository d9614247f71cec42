"""Synthetic vectors that are the same in every run and engine: numbers drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) by md5 of the parts, joined by colons."""
    key = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def uniform(ids: DataFrame, dimensions: int, seed: int = 0) -> DataFrame:
    """(id, vec): for each id a vector on the unit cube."""
    return ids.select("id", F.array(*[hashed_uniform("id", F.lit(j), F.lit(seed)) for j in range(dimensions)]).alias("vec"))


def blobs(rows: DataFrame, means: DataFrame, dimensions: int, spread: float, seed: int = 0) -> DataFrame:
    """(id, label, vec): for each row (id, label) a normal vector around the mean (label, mean) of its label, by the Box-Muller rule."""
    normal = lambda j: F.sqrt(-2 * F.log(1 - hashed_uniform("id", F.lit(j), F.lit("r"), F.lit(seed)))) * F.cos(2 * F.pi() * hashed_uniform("id", F.lit(j), F.lit("a"), F.lit(seed)))
    return rows.join(means, "label").select("id", "label", F.array(*[F.col("mean")[j] + spread * normal(j) for j in range(dimensions)]).alias("vec"))
