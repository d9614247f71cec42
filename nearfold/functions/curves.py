"""Light-curve and path scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days(ts: Column) -> Column:
    """A timestamp as days since the epoch."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0)


def phase(time: Column, period: Column | float) -> Column:
    """Phase in [0, 1) of a time folded by a period."""
    p = period if isinstance(period, Column) else F.lit(float(period))
    return F.pmod(time, p) / p


def object_id(field: Column, tile: Column, seq: Column) -> Column:
    """``field.tile.seq`` as text."""
    return F.format_string("%d.%d.%d", field.cast("int"), tile.cast("int"), seq.cast("int"))


def id_part(identifier: Column, part: int) -> Column:
    """Part 0 (field), 1 (tile), 2 (seq) of an id as an integer; part 3 is the band's text."""
    piece = F.try_element_at(F.split(identifier, r"\."), F.lit(part + 1))
    return piece if part == 3 else piece.cast("int")


def bezier(t: Column, p0: Column, p1: Column, p2: Column) -> Column:
    """A coordinate of the quadratic curve from p0 over control p1 to p2."""
    return (1 - t) * (1 - t) * p0 + 2 * (1 - t) * t * p1 + t * t * p2


def fixed_hash(identifier: Column, seed: str = "") -> Column:
    """A text that orders rows at random, the same in every run and engine."""
    return F.md5(F.concat(identifier.cast("string"), F.lit(seed)).cast("binary"))
