"""Exact quantiles by group without any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import staged

ACCURACY = 10_000


def quantiles(rows: DataFrame, group: Column | str, value: Column | str, ps: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(grp, n, q): the quantiles ``ps`` of each group, an array in their order, interpolated between ranks.

    Approximate quantiles bracket each one; a second pass counts what lies below the bracket and the distinct
    values inside it, about 4 / ``accuracy`` of the rows, and their running counts give the exact ranks.
    Null values are left out.
    """
    x = rows.select((F.col(group) if isinstance(group, str) else group).alias("grp"), (F.col(value) if isinstance(value, str) else value).alias("v")).filter("v IS NOT NULL")
    e = 2 / accuracy
    near = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [b for p in ps for b in (max(0.0, p - e), min(1.0, p + e))], accuracy).alias("b"))
    near = staged(near, "brackets")  # approximate quantiles vary with the order of merging, and both passes must see the same
    both = x.alias("x").join(near.alias("near"), F.col("x.grp").eqNullSafe(F.col("near.grp"))).select("x.grp", "x.v", "near.n", "near.b")
    low, high = (lambda i: F.col("b")[2 * i]), (lambda i: F.col("b")[2 * i + 1])
    sums = [s for i in range(len(ps)) for s in (F.count(F.when(F.col("v") < low(i), 1)).alias(f"below{i}"), F.max(F.when(F.col("v") < low(i), F.col("v"))).alias(f"prev{i}"), F.min(F.when(F.col("v") > high(i), F.col("v"))).alias(f"next{i}"), F.count(F.when(F.col("v").between(low(i), high(i)), 1)).alias(f"inside{i}"))]
    outside = both.groupBy("grp", "n").agg(*sums)
    which = F.array_compact(F.array(*[F.when(F.col("v").between(low(i), high(i)), F.lit(i)) for i in range(len(ps))]))
    inside = both.select("grp", "v", F.explode(which).alias("i")).groupBy("grp", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(W.partitionBy("grp", "i").orderBy("v")))
    # candidates with their first and last rank
    edges = [F.struct(F.lit(i).alias("i"), *[F.col(f"{c}{i}").alias(c) for c in ("below", "prev", "next", "inside")]) for i in range(len(ps))]
    flat = outside.select("grp", "n", F.inline(F.array(*edges)))
    found = inside.alias("a").join(flat.alias("f"), F.col("a.grp").eqNullSafe(F.col("f.grp")) & (F.col("a.i") == F.col("f.i")))
    ranked = found.select("f.grp", "f.n", "f.i", "a.v", (F.col("f.below") + F.col("upto") - F.col("c")).alias("first"), (F.col("f.below") + F.col("upto") - 1).alias("last"))
    prev = flat.filter("prev IS NOT NULL").select("grp", "n", "i", F.col("prev").alias("v"), (F.col("below") - 1).alias("first"), (F.col("below") - 1).alias("last"))
    next_ = flat.filter("next IS NOT NULL").select("grp", "n", "i", F.col("next").alias("v"), (F.col("below") + F.col("inside")).alias("first"), (F.col("below") + F.col("inside")).alias("last"))
    every = ranked.unionByName(prev).unionByName(next_)
    at = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1)
    pick = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("last") >= r), F.col("v")))
    lower, upper = pick(F.floor(at)), pick(F.ceil(at))
    one = every.groupBy("grp", "n", "i").agg((lower + (upper - lower) * F.max(at - F.floor(at))).alias("q"))
    return one.groupBy("grp", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))  # a row per quantile
