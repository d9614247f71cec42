"""Light curves in long form (id, band, t, mag, err): folding, interpolation, alignment, features, periods.

Every operator shuffles observations by curve once; what is summed is summed before the shuffle.
A null magnitude or time is no observation; a null error counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.curves import phase
from ..shared import staged

CHUNK = 100_000


def observations(rows: DataFrame) -> DataFrame:
    """Rows with a time and a magnitude; ``err`` is 1 where there is none."""
    err = F.coalesce("err", F.lit(1.0)) if "err" in rows.columns else F.lit(1.0)
    return rows.filter(F.col("t").isNotNull() & F.col("mag").isNotNull()).withColumn("err", err)


def fold(rows: DataFrame, period: Column | float) -> DataFrame:
    """``rows`` with ``phase`` in [0, 1)."""
    return rows.withColumn("phase", phase(F.col("t"), period))


def without_noise(rows: DataFrame, limit: float = 3.0, spread: float = 5.0) -> DataFrame:
    """Observations whose error is below ``limit`` mean errors and whose magnitude is within ``spread`` deviations."""
    own = observations(rows)
    s = own.groupBy("id").agg(F.avg("mag").alias("m"), F.stddev_pop("mag").alias("s"), F.avg("err").alias("e"))
    kept = (F.col("err") < limit * F.col("e")) & (F.abs(F.col("mag") - F.col("m")) <= spread * F.col("s"))
    return own.join(s, "id").filter(kept).drop("m", "s", "e")


def resolution(rows: DataFrame) -> DataFrame:
    """One row: the median number of observations of a curve."""
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", 0.5).alias("resolution"))


def interpolate(rows: DataFrame, points: int, k: int = 5, weighted: bool = True) -> DataFrame:
    """(id, g, phase, mag) on ``points`` phases g / points: mean of the k observations (id, key, phase, mag)
    nearest in phase, weighted by 1 / distance (equal weights on request).

    Where observations stand at the very phase, their mean is taken.  The k nearest are among the k
    before and the k after a grid point in order of (phase, key): grid points find their place in that
    order and are joined with 2k places, so no grid point meets a whole curve.
    """
    obs = rows.select("id", "phase", "key", "mag")
    grid = obs.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    grid = grid.select("id", (F.col("g") / points).alias("phase"), F.lit(None).cast(dict(obs.dtypes)["key"]).alias("key"), F.lit(None).cast("double").alias("mag"), "g")
    both = obs.withColumn("g", F.lit(None).cast("int")).unionByName(grid)
    order = W.partitionBy("id").orderBy("phase", F.col("g").isNotNull(), "key").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("place", F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).over(order))
    places = both.filter("g IS NOT NULL").select("id", "g", F.col("phase").alias("at"), F.explode(F.sequence(F.col("place") - (k - 1), F.col("place") + k)).alias("place"))
    near = places.join(both.filter("g IS NULL").select("id", "place", "key", "phase", "mag"), ["id", "place"]).withColumn("d", F.abs(F.col("phase") - F.col("at")))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("id", "g").orderBy("d", "key"))).filter(F.col("r") <= k)
    w = F.when(F.col("d") > 0, 1 / F.col("d")) if weighted else F.lit(1.0)
    exact = F.avg(F.when(F.col("d") == 0, F.col("mag")))
    mean = F.sum(w * F.col("mag")) / F.sum(w)
    return near.groupBy("id", "g").agg(F.first("at").alias("phase"), (F.coalesce(exact, mean) if weighted else mean).alias("mag"))


def pair_bands(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(id, n_first, n_second, present): present is 0 with both bands, 1 with only the first, 2 with only the second."""
    of = lambda b: F.count(F.when(F.col("band") == b, 1))
    out = rows.filter(F.col("band").isin(first, second)).groupBy("id").agg(of(first).alias("n_first"), of(second).alias("n_second"))
    return out.withColumn("present", F.when(F.col("n_second") == 0, 1).when(F.col("n_first") == 0, 2).otherwise(0))


def align(rows: DataFrame, first: str, second: str, within: float) -> DataFrame:
    """(id, t, mag, t2, mag2): each observation of a band with the last one of the other at or before it,
    at most ``within`` days old; those without one go."""
    both = rows.filter(F.col("band").isin(first, second)).select("id", "t", "mag", (F.col("band") == first).alias("is_first"))
    order = W.partitionBy("id").orderBy("t", "is_first").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("is_first"), F.struct("t", "mag")), ignorenulls=True).over(order)
    out = both.withColumn("o", last).filter(F.col("is_first") & (F.col("t") - F.col("o.t") <= within))
    return out.select("id", "t", "mag", F.col("o.t").alias("t2"), F.col("o.mag").alias("mag2"))


# --- curves in tasks ------------------------------------------------------------------------


def whole_curves(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[pa.Table, np.ndarray, list[np.ndarray]]]:
    """Many whole curves at once from rows that stand by their first ``keys`` columns: the first row of each, where
    each begins (and the last ends), and the other columns as arrays.  Only a curve that may go on is carried over."""
    held, rows, need = [], 0, 0

    def cut(table: pa.Table, last: bool) -> tuple[np.ndarray, int]:
        codes = [table.column(i).combine_chunks().dictionary_encode("encode").indices.to_numpy() for i in range(keys)]
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        return (np.r_[first, table.num_rows], table.num_rows) if last else (first, int(first[-1]))

    def out(table: pa.Table, start: np.ndarray) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
        return table.take(pa.array(start[:-1])), start, [table.column(i).to_numpy() for i in range(keys, table.num_columns)]

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows <= need:
            continue
        table = pa.Table.from_batches(held)
        start, upto = cut(table, False)
        if upto:
            yield out(table.slice(0, upto), start)
        held = table.slice(upto).to_batches()
        rows = table.num_rows - upto
        need = 2 * rows  # a long curve is looked at again when it has doubled
    if rows:
        table = pa.Table.from_batches(held)
        yield out(table, cut(table, True)[0])


# --- features -------------------------------------------------------------------------------

PLACES = (5, 10, 17, 25, 32, 40, 60, 67, 75, 82, 90, 95)


def features(rows: DataFrame) -> DataFrame:
    """A row per curve with the features that are closed formulas of its observations (id, t, mag, err).

    Undefined values (a constant curve, too few observations) are null.  Names and formulas are those
    of published time-series feature sets.
    """
    own = observations(rows).select("id", "t", "mag", "err")
    every, by_time = W.partitionBy("id"), W.partitionBy("id").orderBy("t", "mag")
    c, m = F.col, F.col("mag")
    x = own.withColumns({
        "n": F.count(F.lit(1)).over(every), "mean": F.avg("mag").over(every), "sd": F.stddev_pop("mag").over(every),
        "low": F.min("mag").over(every), "high": F.max("mag").over(every), "median": F.percentile("mag", 0.5).over(every),
        "dt": c("t") - F.lag("t").over(by_time), "dm": m - F.lag("mag").over(by_time),
        "next": F.lead("mag").over(by_time), "then": F.lead("mag", 2).over(by_time),
        "back": F.row_number().over(W.partitionBy("id").orderBy(F.desc("t"), F.desc("mag"))),
        "up": F.row_number().over(W.partitionBy("id").orderBy("mag", "t")),
    })
    x = x.withColumns({"z": F.when(c("high") > c("low"), (m - c("mean")) / c("sd")), "w": F.when(c("dt") > 0, 1 / (c("dt") * c("dt"))), "tail": F.ceil(F.lit(0.05) * c("n")), "sig": (m - c("mean")) / c("err")})
    x = x.withColumn("walk", F.sum("z").over(by_time.rowsBetween(W.unboundedPreceding, 0)) / c("n"))
    side = lambda v: F.when(v - c("mean") > 2 * c("sd"), 1).when(v - c("mean") < -2 * c("sd"), -1).otherwise(0)
    run = (side(m) != 0) & (side(m) == side(c("next"))) & (side(m) == side(c("then")))
    g = x.groupBy("id").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("sd").alias("sd"), F.max("median").alias("median"),
        (F.percentile(F.when(c("up") > c("n") - c("tail"), m), 0.5) - F.percentile(F.when(c("up") <= c("tail"), m), 0.5)).alias("ends"),
        F.avg(F.when(F.abs(m - c("mean")) > c("sd") * F.sqrt(F.try_divide(c("n"), c("n") - 1)), 1.0).otherwise(0.0)).alias("beyond"),
        F.sum(F.when(run, 1).otherwise(0)).alias("runs"),
        F.avg("w").alias("w_mean"), F.sum("w").alias("w_sum"), F.sum(c("w") * c("dm") * c("dm")).alias("w_dm"), (F.max("t") - F.min("t")).alias("length"),
        F.regr_slope("mag", "t").alias("slope"), F.max(F.when(c("dt") > 0, F.abs(c("dm") / c("dt")))).alias("steepest"),
        F.percentile(F.abs(m - c("median")), 0.5).alias("mad"), F.max(F.abs(m - c("median"))).alias("far"),
        F.avg(F.when(F.abs(m - c("median")) < (c("high") - c("low")) / 20, 1.0).otherwise(0.0)).alias("near"),
        F.count(F.when((c("back") < 30) & (c("dm") > 0), 1)).alias("ups"), F.count(F.when((c("back") < 30) & (c("dm") <= 0), 1)).alias("downs"),
        (F.percentile("mag", 0.75) - F.percentile("mag", 0.25)).alias("q31"),
        (F.max("walk") - F.min("walk")).alias("rcs"), F.avg(F.pow("z", F.lit(3.0))).alias("skew"), F.sum(F.pow("z", F.lit(4.0))).alias("z4"),
        F.sum(F.abs("sig")).alias("sig"), F.sum(c("sig") * c("sig")).alias("sig2"),
        *[_place(p).alias(f"f{p}") for p in PLACES],
    )
    n, spread = c("n").cast("double"), c("f95") - c("f5")
    over = lambda a, b: F.when(b != 0, a / b)
    unbiased = c("z4") * F.pow((n - 1) / n, F.lit(2.0))
    return g.select(
        "id", "n", (c("ends") / 2).alias("Amplitude"), c("beyond").alias("Beyond1Std"), over(c("runs"), n - 2).alias("Con"),
        over(c("w_mean") * c("length") * c("length") * c("w_dm"), c("sd") * c("sd") * c("w_sum") * n * n).alias("Eta_e"),
        *[over(c(f"f{b}") - c(f"f{a}"), spread).alias(f"FluxPercentileRatioMid{name}") for name, a, b in ((20, 40, 60), (35, 32, 67), (50, 25, 75), (65, 17, 82), (80, 10, 90))],
        c("slope").alias("LinearTrend"), c("steepest").alias("MaxSlope"), c("mean").alias("Mean"), over(c("sd"), c("mean")).alias("Meanvariance"),
        c("mad").alias("MedianAbsDev"), c("near").alias("MedianBRP"), ((c("ups") - c("downs")) / 30).alias("PairSlopeTrend"),
        over(c("far"), c("median")).alias("PercentAmplitude"), over(spread, c("median")).alias("PercentDifferenceFluxPercentile"),
        c("q31").alias("Q31"), c("rcs").alias("Rcs"), c("skew").alias("Skew"),
        F.when(n > 3, n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * unbiased - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))).alias("SmallKurtosis"),
        c("sd").alias("Std"), over(c("sig"), F.sqrt(n) * F.sqrt(c("sig2"))).alias("StetsonK"),
    )


def _place(percent: int) -> Column:
    """The magnitude at place ceil(percent * n / 100), from 0, in order."""
    at = F.least(F.ceil(F.lit(percent) * F.col("n") / 100), F.col("n") - 1)
    return F.max(F.when(F.col("up") == at + 1, F.col("mag")))


LAGS = 100


def _normal(z: Column) -> Column:
    """The normal distribution function, by a rational approximation of erf good to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def order_features(rows: DataFrame, lags: int = LAGS) -> DataFrame:
    """(id, n, AndersonDarling, Autocor_length): a logistic of the normality statistic, and the first lag
    (in observations, up to ``lags``) whose autocorrelation is below 1/e; null where there is none."""
    every, own = W.partitionBy("id"), observations(rows).select("id", "t", "mag")
    x = own.withColumns({"n": F.count(F.lit(1)).over(every), "m": F.avg("mag").over(every), "sd": F.stddev_pop("mag").over(every), "up": F.row_number().over(W.partitionBy("id").orderBy("mag", "t"))})
    y = F.col("mag") - F.col("m")
    x = x.filter("sd > 0").withColumn("y", y).withColumn("p", F.greatest(F.least(_normal(F.col("y") / F.col("sd")), F.lit(1 - 1e-9)), F.lit(1e-9)))
    rank = 2 * F.col("up") - 1
    a2 = -F.max("n") - F.sum(rank * F.log("p") + (2 * F.col("n") - rank) * F.log(1 - F.col("p"))) / F.max("n")
    g = x.groupBy("id").agg(F.max("n").alias("n"), a2.alias("a2"))

    def first_below(y: np.ndarray) -> int | None:
        y = y - y.mean()
        square = (y * y).sum()
        return next((k for k in range(1, min(lags, len(y) - 1) + 1) if square > 0 and (y[:-k] * y[k:]).sum() / square < np.exp(-1)), None)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, start, (_, mag) in whole_curves(batches):
            found = [first_below(mag[a:z]) for a, z in zip(start[:-1], start[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([first.column(0).combine_chunks(), pa.array(found, pa.int64())], ["id", "lag"])

    lag = own.repartition("id").sortWithinPartitions("id", "t", "mag").mapInArrow(lengths, f"id {dict(rows.dtypes)['id']}, lag long")
    return g.join(lag, "id", "left").select("id", "n", (1 / (1 + F.exp(-10 * (F.col("a2") - 0.3)))).alias("AndersonDarling"), F.col("lag").alias("Autocor_length"))


def harmonics(rows: DataFrame, low: float, high: float, steps: int, frequencies: int = 3, orders: int = 4) -> DataFrame:
    """A row per curve: amplitudes and relative phases of ``orders`` multiples of its strongest frequency, then of the
    strongest one left when those are taken away, and so on.

    Each multiple is fitted by least squares on centred sums, which are additive; a phase is relative to
    that of the first multiple.
    """
    left = observations(rows).select("id", "t", "mag")
    out = left.select("id").distinct()
    for i in range(1, frequencies + 1):
        left = staged(left, "left")
        own = staged(periods(left, low, high, steps).select("id", (2 * F.pi() / F.col("period")).alias("w")), "periods")
        x = left.join(own, "id")
        for j in range(orders):
            x = x.withColumns({f"s{j}": F.sin((j + 1) * F.col("w") * F.col("t")), f"c{j}": F.cos((j + 1) * F.col("w") * F.col("t"))})
        cov = lambda a, b, j: F.covar_pop(f"{a}{j}", "mag" if b == "y" else f"{b}{j}").alias(f"{a}{b}{j}")
        g = x.groupBy("id").agg(*[cov(*ab, j) for j in range(orders) for ab in ("ss", "cc", "sc", "sy", "cy")])
        fit = []
        for j in range(orders):
            ss, cc, sc, sy, cy = (F.col(f"{ab}{j}") for ab in ("ss", "cc", "sc", "sy", "cy"))
            det = ss * cc - sc * sc
            fit += [F.when(det > 1e-12, (sy * cc - cy * sc) / det).otherwise(0.0).alias(f"a{j}"), F.when(det > 1e-12, (cy * ss - sy * sc) / det).otherwise(0.0).alias(f"b{j}")]
        fits = staged(g.select("id", *fit), "fits")
        wave = sum((F.col(f"a{j}") * F.col(f"s{j}") + F.col(f"b{j}") * F.col(f"c{j}") for j in range(orders)), F.lit(0.0))
        left = x.join(fits, "id").select("id", "t", (F.col("mag") - wave).alias("mag"))
        size = [F.hypot(f"a{j}", f"b{j}").alias(f"Freq{i}_harmonics_amplitude_{j}") for j in range(orders)]
        turn = [(F.atan2(f"b{j}", f"a{j}") - F.atan2("b0", "a0")).alias(f"Freq{i}_harmonics_rel_phase_{j}") for j in range(orders)]
        out = out.join(fits.select("id", *size, *turn), "id", "left")
    return out


def colour_features(rows: DataFrame, first: str, second: str, within: float) -> DataFrame:
    """A row per curve with both bands aligned: Color, Q31_color, Eta_color, StetsonJ and StetsonL."""
    pairs = align(observations(rows), first, second, within)
    every = W.partitionBy("id")
    n = F.count(F.lit(1)).over(every)
    scale = F.sqrt(F.try_divide(n, n - 1))
    score = lambda v: scale * F.try_divide(F.col(v) - F.avg(v).over(every), F.stddev_pop(v).over(every))
    by_time = W.partitionBy("id").orderBy("t", "mag")
    x = pairs.withColumns({"n": n, "c": F.col("mag") - F.col("mag2"), "z1": score("mag"), "z2": score("mag2"), "dt": F.col("t") - F.lag("t").over(by_time)})
    x = x.withColumns({"p": F.col("z1") * F.col("z2"), "dc": F.col("c") - F.lag("c").over(by_time), "w": F.when(F.col("dt") > 0, 1 / (F.col("dt") * F.col("dt")))})
    j = F.avg(F.signum("p") * F.sqrt(F.abs("p")))
    k = F.sum(F.abs("z1")) / (F.sqrt(F.max("n")) * F.sqrt(F.sum(F.col("z1") * F.col("z1"))))
    eta = F.try_divide(F.avg("w") * F.pow(F.max("t") - F.min("t"), F.lit(2.0)) * F.sum(F.col("w") * F.col("dc") * F.col("dc")), F.var_pop("c") * F.sum("w") * F.max("n") * F.max("n"))
    return x.groupBy("id").agg(
        F.max("n").alias("n"), F.avg("c").alias("Color"), (F.percentile("c", 0.75) - F.percentile("c", 0.25)).alias("Q31_color"),
        eta.alias("Eta_color"), j.alias("StetsonJ"), (j * k / 0.798).alias("StetsonL"),
    )


def _power(yc: np.ndarray, ys: np.ndarray, cc: np.ndarray, ss: np.ndarray, cs: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The normalised power from the sums over a curve of variance ``v``."""
    turn = np.arctan2(2 * cs, cc - ss) / 2  # the shift tau makes the cross sum vanish: rotate the sums by w * tau
    c, s = np.cos(turn), np.sin(turn)
    both = cc * c * c + 2 * cs * c * s + ss * s * s, cc * s * s - 2 * cs * c * s + ss * c * c
    with np.errstate(divide="ignore", invalid="ignore"):
        total = sum(np.where(b > 1e-9, a * a / b, 0.0) for a, b in zip((yc * c + ys * s, ys * c - yc * s), both, strict=True))
        return np.where(v > 0, total / (2 * v), 0.0)


def _sums(start: np.ndarray, t: np.ndarray, y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """The five sums of each curve at each frequency: (5, frequencies, curves)."""
    out = np.zeros((5, len(omega), len(start) - 1))
    for lo in range(0, int(start[-1]), 2_048):
        hi = min(lo + 2_048, int(start[-1]))
        a, z = np.searchsorted(start, lo, "right") - 1, np.searchsorted(start, hi, "left")
        cuts = np.maximum(start[a:z], lo) - lo
        c, s = np.cos(w := np.outer(omega, t[lo:hi])), np.sin(w)
        p = y[lo:hi]
        for i, x in enumerate((c * p, s * p, c * c, s * s, c * s)):
            out[i, :, a:z] += np.add.reduceat(x, cuts, axis=1)
    return out


_SUMS = ("yc", "ys", "cc", "ss", "cs")


def _periodogram(rows: DataFrame, frequencies: np.ndarray, chunk: int, best: bool) -> DataFrame:
    """(id, f, power) of each frequency, or of the strongest (the first of equal ones).

    The sums over observations are additive, so where there are curves of more than ``chunk`` observations they are dealt
    over tasks and their sums added; else a curve's power is settled where its observations are.
    """
    own = observations(rows).select("id", "t", "mag")
    s = staged(own.groupBy("id").agg(F.avg("mag").alias("m"), F.var_pop("mag").alias("v"), F.min("t").alias("t0"), F.count(F.lit(1)).alias("n")), "curves")
    omega, kind = 2 * np.pi * frequencies, dict(rows.dtypes)["id"]
    parts = F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / chunk))
    own = own.join(s, "id").select("id", parts.alias("part"), (F.col("t") - F.col("t0")).alias("t"), (F.col("mag") - F.col("m")).alias("y"), "v")
    one = (s.agg(F.max("n")).first()[0] or 0) <= chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, start, (t, y, v) in whole_curves(batches, 2):
            for at in range(0, len(start) - 1, 1_000):
                cut = start[at : at + 1_001]
                sums = _sums(cut - cut[0], t[cut[0] : cut[-1]], y[cut[0] : cut[-1]], omega)
                own, v_of = first.column(0).slice(at, len(cut) - 1).combine_chunks(), v[cut[:-1]]
                if one and best:
                    power = _power(*sums, v_of)
                    f = power.argmax(0)
                    yield pa.RecordBatch.from_arrays([own, pa.array(f.astype(np.int32)), pa.array(power[f, np.arange(len(f))])], ["id", "f", "power"])
                    continue
                each = own.take(pa.array(np.repeat(np.arange(len(own)), len(omega))))
                f = pa.array(np.tile(np.arange(len(omega), dtype=np.int32), len(own)))
                if one:
                    yield pa.RecordBatch.from_arrays([each, f, pa.array(_power(*sums, v_of).T.ravel())], ["id", "f", "power"])
                else:
                    yield pa.RecordBatch.from_arrays([each, f, *(pa.array(x.T.ravel()) for x in sums), pa.array(np.repeat(v_of, len(omega)))], ["id", "f", *_SUMS, "v"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_power(*(b.column(i).to_numpy() for i in range(2, 8))))], ["id", "f", "power"])

    dealt = own.repartition("id", "part").sortWithinPartitions("id", "part")
    if one:
        return dealt.mapInArrow(run, f"id {kind}, f int, power double")
    sums = dealt.mapInArrow(run, f"id {kind}, f int, " + ", ".join(f"{c} double" for c in (*_SUMS, "v")))
    total = sums.groupBy("id", "f").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("v").alias("v"))
    power = total.mapInArrow(settle, f"id {kind}, f int, power double")
    if not best:
        return power
    found = power.groupBy("id").agg(F.max_by(F.struct("f", "power"), F.struct("power", -F.col("f"))).alias("b"))
    return found.select("id", "b.f", "b.power")


def periodogram(rows: DataFrame, frequencies: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(id, f, power): the normalised Lomb-Scargle power of each curve at each frequency (place ``f``)."""
    return _periodogram(rows, frequencies, chunk, best=False)


def periods(rows: DataFrame, low: float, high: float, steps: int, chunk: int = CHUNK) -> DataFrame:
    """(id, period, power) of the strongest of ``steps`` frequencies from ``low`` to ``high`` per day."""
    best = _periodogram(rows, np.linspace(low, high, steps), chunk, best=True)
    return best.select("id", (1 / (F.lit(low) + F.col("f") * ((high - low) / (steps - 1)))).alias("period"), "power")


def folded_features(rows: DataFrame) -> DataFrame:
    """(id, Psi_CS, Psi_eta) of observations with ``phase``: range of the running sum and eta in order of phase."""
    every, order = W.partitionBy("id"), W.partitionBy("id").orderBy("phase", "t")
    x = observations(rows).withColumns({"n": F.count(F.lit(1)).over(every), "m": F.avg("mag").over(every), "sd": F.stddev_pop("mag").over(every)})
    x = x.withColumn("dm", F.col("mag") - F.lag("mag").over(order)).withColumn("z", F.when(F.col("sd") > 0, (F.col("mag") - F.col("m")) / F.col("sd")))
    x = x.withColumn("walk", F.sum("z").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.col("n"))
    eta = F.sum(F.col("dm") * F.col("dm")) / (F.max(F.col("n") - 1) * F.max(F.col("sd") * F.col("sd")))
    return x.filter("sd > 0").groupBy("id").agg((F.max("walk") - F.min("walk")).alias("Psi_CS"), eta.alias("Psi_eta"))


SLOT, SLOTS = 1.0, 20
TAUS, SIGMAS, ROUNDS = 16, 12, 4
TOGETHER = 32


def slotted_autocorrelation(t: np.ndarray, y: np.ndarray, slot: float = SLOT, slots: int = SLOTS) -> np.ndarray:
    """Autocorrelation of centred values at irregular times by slots of the lag; place 0 is 1.

    Running sums over the later observations of a slot make it linear in observations times slots.
    """
    run = np.concatenate([[0], np.cumsum(y)])
    out, own, step = np.full(slots, np.nan), np.arange(len(t)), max(1, 1_000_000 // max(1, len(t)))
    for at in range(0, slots, step):  # slots together, fewer of a long curve
        edges = (np.arange(at, min(at + step, slots) + 1) - 0.5) * slot
        places = np.maximum(np.searchsorted(t, t + edges[:, None]), own)
        lo, hi = places[:-1], places[1:]
        n = (hi - lo).sum(1)
        total = (y * (run[hi] - run[lo])).sum(1)
        out[at : at + len(n)] = np.where(n > 0, total / np.maximum(n, 1), np.nan)
    return out / out[0] if out[0] else out * np.nan


def autoregressive(t: np.ndarray, mag: np.ndarray, err: np.ndarray) -> tuple[float, float, float]:
    """``autoregressive_fits`` of one curve."""
    return tuple(autoregressive_fits([(t, mag, err)])[0].tolist())


def autoregressive_fits(curves: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """(mean, sigma, tau) of the continuous first-order autoregressive process of greatest likelihood, a row for each curve (t, mag, err).

    The likelihood comes from the usual prediction and correction over the observations, for a grid of
    (tau, sigma) at once; the grid closes in on its best place ``ROUNDS`` times.  ``TOGETHER`` curves of like
    length go through their observations together, the longest first, so that those that go on stand in front.
    """
    out = np.zeros((len(curves), 3))
    order = np.argsort([-len(c[0]) for c in curves], kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        out[some] = _fits([curves[i] for i in some])
    return out


def _fits(curves: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    m, size = len(curves), np.array([len(t) for t, _, _ in curves])
    x, noise, dt = (np.zeros((size[0], m)) for _ in range(3))
    low, high, mean = np.zeros((m, 2)), np.zeros((m, 2)), np.zeros(m)
    for i, (t, mag, err) in enumerate(curves):
        span, spread, mean[i] = max(float(t[-1] - t[0]), 1e-3), max(float(mag.std()), 1e-9), mag.mean()
        low[i], high[i] = np.log([1e-2, spread * 1e-2]), np.log([10 * span, spread * 1e2])
        x[: size[i], i], noise[: size[i], i], dt[: size[i] - 1, i] = mag - mean[i], err**2, np.diff(t)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # curves of more than i observations
    best, found, own = np.full(m, -np.inf), np.zeros((m, 2)), np.arange(m)
    for _ in range(ROUNDS):
        tau = np.exp(np.linspace(low[:, 0], high[:, 0], TAUS, axis=1))[:, :, None]
        sigma = np.exp(np.linspace(low[:, 1], high[:, 1], SIGMAS, axis=1))[:, None, :]
        still = tau * sigma**2 / 2
        guess, omega = np.zeros_like(still), still.copy()
        spread = omega + noise[0][:, None, None]
        total = -0.5 * (np.log(2 * np.pi * spread) + x[0][:, None, None] ** 2 / spread)
        for i in range(1, size[0]):
            k = live[i]
            if k < len(guess):
                guess, omega, spread = guess[:k], omega[:k], spread[:k]
            a = np.exp(-dt[i - 1, :k, None, None] / tau[:k])
            gain = omega / spread
            guess = a * (guess + gain * (x[i - 1, :k, None, None] - guess))
            omega = still[:k] * (1 - a * a) + a * a * omega * (1 - gain)
            spread = omega + noise[i, :k, None, None]
            total[:k] += -0.5 * (np.log(2 * np.pi * spread) + (guess - x[i, :k, None, None]) ** 2 / spread)
        flat = total.reshape(m, -1)
        at = flat.argmax(1)
        better = flat[own, at] > best
        best = np.where(better, flat[own, at], best)
        found[better] = np.stack([tau[own, at // SIGMAS, 0], sigma[own, 0, at % SIGMAS]], 1)[better]
        step = (high - low) / [TAUS - 1, SIGMAS - 1]
        middle = np.log(found)
        low, high = middle - step, middle + step
    return np.stack([mean / found[:, 0], found[:, 1], found[:, 0]], 1)


def irregular_features(rows: DataFrame, fits: bool = True) -> DataFrame:
    """(id, CAR_mean, CAR_sigma, CAR_tau, SlottedA_length, StetsonK_AC): those that go through a curve in order.

    The first lag (in days) whose slotted autocorrelation is below 1/e, Stetson's K of that function, and the
    autoregressive fit (left out on request).  Curves of fewer than three observations, or constant ones, have nulls.
    """
    kind, names = dict(rows.dtypes)["id"], [c for c in _IRREGULAR if fits or not c.startswith("CAR_")]

    def of(t: np.ndarray, mag: np.ndarray) -> tuple[float | None, float | None]:
        ac = slotted_autocorrelation(t, mag - mag.mean())
        below = np.flatnonzero(ac < np.exp(-1))
        seen = ac[np.isfinite(ac)]
        n, sd = len(seen), seen.std()
        z = np.sqrt(n / (n - 1)) * (seen - seen.mean()) / sd if n > 1 and sd > 0 else np.zeros(0)
        return float(below[0] * SLOT) if len(below) else None, float(np.abs(z).sum() / (np.sqrt(n) * np.sqrt((z * z).sum()))) if len(z) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, start, columns in whole_curves(batches):
            own = [tuple(c[a:z] for c in columns) for a, z in zip(start[:-1], start[1:], strict=True)]
            whole = [i for i, (t, mag, _) in enumerate(own) if len(t) > 2 and mag.std() > 0 and t[-1] > t[0]]
            out: list[list[float | None]] = [[None] * len(names) for _ in own]
            fitted = autoregressive_fits([own[i] for i in whole]).tolist() if fits else [[]] * len(whole)
            for i, fit in zip(whole, fitted, strict=True):
                out[i] = [*fit, *of(*own[i][:2])]
            cells = [pa.array([None if x is None or x != x else x for x in c], pa.float64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([first.column(0).combine_chunks(), *cells], ["id", *names])

    own = observations(rows).select("id", "t", "mag", "err")
    return own.repartition("id").sortWithinPartitions("id", "t", "mag", "err").mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in names))


def period_features(rows: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    """(id, PeriodLS, Period_fit): the strongest period and the chance of such a power among ``steps`` frequencies of noise."""
    found = periods(rows, low, high, steps)
    return found.select("id", F.col("period").alias("PeriodLS"), (1 - F.pow(1 - F.exp(-F.col("power")), F.lit(float(steps)))).alias("Period_fit"))


GRID = (0.05, 1.0, 96)
_ORDER = ("AndersonDarling", "Autocor_length")
_COLOUR = ("Color", "Q31_color", "Eta_color", "StetsonJ", "StetsonL")
_IRREGULAR = ("CAR_mean", "CAR_sigma", "CAR_tau", "SlottedA_length", "StetsonK_AC")
_PERIOD = ("PeriodLS", "Period_fit")
_FOLDED = ("Psi_CS", "Psi_eta")


def selected_features(rows: DataFrame, names: list[str], first: str | None = None, second: str | None = None, within: float = 2.0, grid: tuple[float, float, int] = GRID) -> DataFrame:
    """(id, names...): the features chosen by name, of band ``first`` (of all observations if none is given).

    Only the groups of features that hold a chosen one are computed; those of two bands need both.
    """
    one = staged(observations(rows if first is None else rows.filter(F.col("band") == first)), "band") if first else observations(rows)
    wanted, parts = set(names), []
    if wanted & set(_ORDER):
        parts.append(order_features(one).drop("n").withColumn("Autocor_length", F.col("Autocor_length").cast("double")))
    if wanted & set(_COLOUR):
        if first is None or second is None:
            raise ValueError("features of two bands need both bands")
        parts.append(colour_features(rows, first, second, within).drop("n"))
    if wanted & set(_IRREGULAR):
        parts.append(irregular_features(one, any(n.startswith("CAR_") for n in wanted)))
    if wanted & {*_PERIOD, *_FOLDED}:
        own = staged(period_features(one, *grid), "period")
        parts.append(own)
        if wanted & set(_FOLDED):
            folded = one.join(own.select("id", F.col("PeriodLS").alias("p")), "id").withColumn("phase", phase(F.col("t"), F.col("p")))
            parts.append(folded_features(folded.drop("p")))
    if any(n.startswith("Freq") for n in wanted):
        parts.append(harmonics(one, *grid))
    known = {c for p in parts for c in p.columns}
    out = features(one).drop("n") if wanted - known else one.select("id").distinct()
    if missing := wanted - known - set(out.columns):
        raise ValueError(f"no such features: {sorted(missing)}")
    for p in parts:
        out = out.join(p, "id", "left")
    return out.select("id", *names)


def tile_features(rows: DataFrame, names: list[str], first: str, second: str, within: float = 2.0) -> DataFrame:
    """(id, names...): all features of the curves of a tile (id, band, t, mag, err), both bands paired."""
    paired = pair_bands(observations(rows), first, second).filter("present = 0").select("id")
    return selected_features(rows.join(paired, "id", "left_semi"), names, first, second, within)


# --- documents ------------------------------------------------------------------------------


def nest(rows: DataFrame) -> DataFrame:
    """A row per curve: (id, n, observations), the latter an array of (t, mag, err) in order of time."""
    own = observations(rows)
    return own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("t", "mag", "err"))).alias("observations"))


def unnest(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.inline("observations"))
