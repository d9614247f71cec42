"""Queries over light curves: folding, interpolation, bands, features, periods, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves as ops
from ..shared import new_path, staged
from ..sources.features import FEATURES as ALL_FEATURES
from ..sources.tiles import read_tar_tiles, write_tar_tiles
from .common import C, curves

PERIOD = 7.0
POINTS = 50
FIRST, SECOND = "click", "view"
WITHIN = 2.0
DIGITS = 5
NUDGE = 1e-9  # a mean of few decimals may stand just between two roundings; engines differ in its last bit
FEATURES = (
    "Amplitude Beyond1Std Con Eta_e FluxPercentileRatioMid20 FluxPercentileRatioMid35 FluxPercentileRatioMid50 FluxPercentileRatioMid65 FluxPercentileRatioMid80 "
    "LinearTrend MaxSlope Mean Meanvariance MedianAbsDev MedianBRP PairSlopeTrend PercentAmplitude PercentDifferenceFluxPercentile Q31 Rcs Skew SmallKurtosis Std StetsonK"
).split()


def _rounded(rows: DataFrame, names: list[str], *keep: str, digits: int = DIGITS) -> DataFrame:
    return rows.select(*keep, *[F.round(n, digits).alias(n) for n in names])


def phase_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fold(curves(spark, sf_dir), PERIOD).select("id", "key", F.round("phase", 6).alias("phase"), "mag")


def grid_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolution(curves(spark, sf_dir))


def _grid(weighted: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ops.interpolate(ops.fold(curves(spark, sf_dir), PERIOD), POINTS, weighted=weighted)
        return out.select("id", F.col("g").cast("long").alias("g"), F.round("phase", 6).alias("phase"), F.round("mag", 4).alias("mag"))

    return run


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.without_noise(curves(spark, sf_dir)).select("id", "key", "mag")


def band_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pair_bands(curves(spark, sf_dir), FIRST, SECOND).select("id", "n_first", "n_second", F.col("present").cast("long").alias("present"))


def band_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.align(curves(spark, sf_dir), FIRST, SECOND, WITHIN), ["t", "mag", "t2", "mag2"], "id", digits=6)


def lc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.features(curves(spark, sf_dir)), FEATURES, "id", "n")


def lc_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features chosen by name."""
    names = ["Mean", "Std", "Skew"]
    return _rounded(ops.selected_features(curves(spark, sf_dir), names), names, "id")


def lc_tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 features of the curves of a tile, packed as text in a tar, read back, both bands paired."""
    rows = curves(spark, sf_dir).withColumn("err", F.lit(1.0)).withColumn("tile", F.col("id") % 8)
    path = new_path(spark, "tiles")
    write_tar_tiles(rows, path)
    back = staged(read_tar_tiles(spark, path), "tile").filter("problem IS NULL").withColumn("id", F.col("id").cast("long"))
    return _rounded(ops.tile_features(back, ALL_FEATURES, FIRST, SECOND, WITHIN), ALL_FEATURES, "id", digits=4)


def lc_tile_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of a tile's features that SQL can state."""
    names = [*FEATURES, "Color", "Q31_color", "StetsonJ", "StetsonL"]
    out = ops.tile_features(curves(spark, sf_dir), names, FIRST, SECOND, WITHIN)
    return _rounded(out.select("id", *[(F.col(n) + NUDGE).alias(n) for n in names]), names, "id")


def lc_period_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.period_features(curves(spark, sf_dir), *ops.GRID), ["PeriodLS", "Period_fit"], "id", digits=4)


def lc_irregular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.irregular_features(curves(spark, sf_dir))
    return _rounded(out, [c for c in out.columns if c != "id"], "id", digits=4)


def lc_slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the slotted autocorrelation."""
    return ops.irregular_features(curves(spark, sf_dir), fits=False).select("id", "SlottedA_length")


def lc_colour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.colour_features(curves(spark, sf_dir), FIRST, SECOND, WITHIN), ["Color", "Q31_color", "Eta_color", "StetsonJ", "StetsonL"], "id", "n")


def lc_folded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.folded_features(ops.fold(curves(spark, sf_dir), PERIOD)), ["Psi_CS", "Psi_eta"], "id")


def lc_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.periods(curves(spark, sf_dir), 0.05, 1.0, 96), ["period", "power"], "id")


def lc_order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.order_features(curves(spark, sf_dir)), ["AndersonDarling"], "id", "n", "Autocor_length")


def lc_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.harmonics(curves(spark, sf_dir), 0.05, 1.0, 96)
    return _rounded(out, [c for c in out.columns if c != "id"], "id")


def curve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves nested as documents: count, first and last observation."""
    docs = ops.nest(curves(spark, sf_dir))
    first, last = F.col("observations")[0], F.element_at("observations", -1)
    return _rounded(docs.select("id", "n", first["t"].alias("t_first"), first["mag"].alias("mag_first"), last["t"].alias("t_last"), last["mag"].alias("mag_last")), ["t_first", "mag_first", "t_last", "mag_last"], "id", "n", digits=6)


def curve_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken apart again: as many observations, with the same sums."""
    rows = ops.unnest(ops.nest(curves(spark, sf_dir)))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mag"), 4).alias("mag"))


def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(spark, sf_dir).groupBy("id", "band").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    phase_fold, grid_resolution, noise_filter, band_full_outer, band_align, lc_features, lc_selected, lc_tile_features, lc_tile_closed, lc_period_fit, lc_irregular_features, lc_slotted, lc_colour_features, lc_folded_features, lc_period, lc_order_features, lc_harmonics,
    curve_documents, curve_observations, observation_counts,
)} | {"interpolate_grid": _grid(True), "interpolate_grid_uniform": _grid(False)}


def _grid_sql(mag: str) -> str:
    return f"""
WITH {C}, o AS (SELECT id, key, mag, fmod(t, {PERIOD}) / {PERIOD} AS phase FROM c),
g AS (SELECT id, g, g / {POINTS}::DOUBLE AS pt FROM (SELECT DISTINCT id FROM c), range({POINTS}) r(g)),
d AS (SELECT id, g, pt, mag, abs(phase - pt) AS d, row_number() OVER (PARTITION BY id, g ORDER BY abs(phase - pt), key) AS r FROM g JOIN o USING (id))
SELECT id, g, round(any_value(pt), 6) AS phase, round({mag}, 4) AS mag FROM d WHERE r <= 5 GROUP BY id, g"""


_ALIGNED = f"a AS (SELECT l.id, l.t, l.mag, r.t AS t2, r.mag AS mag2 FROM (SELECT * FROM c WHERE band = '{FIRST}') l ASOF JOIN (SELECT * FROM c WHERE band = '{SECOND}') r ON l.id = r.id AND l.t >= r.t WHERE l.t - r.t <= {WITHIN})"
_PLACES = ", ".join(f"max(mag) FILTER (WHERE up = least(ceil({p} * n / 100.0), n - 1) + 1) AS f{p}" for p in ops.PLACES)
_FEATURES = f"""
WITH {C}, b AS (
  SELECT id, t, mag AS m, count(*) OVER e AS n, avg(mag) OVER e AS mean, stddev_pop(mag) OVER e AS sd, min(mag) OVER e AS lo, max(mag) OVER e AS hi, quantile_cont(mag, 0.5) OVER e AS med,
         t - lag(t) OVER o AS dt, mag - lag(mag) OVER o AS dm, lead(mag) OVER o AS m1, lead(mag, 2) OVER o AS m2,
         row_number() OVER (PARTITION BY id ORDER BY t DESC, mag DESC) AS back, row_number() OVER (PARTITION BY id ORDER BY mag, t) AS up, mag
  FROM c WINDOW e AS (PARTITION BY id), o AS (PARTITION BY id ORDER BY t, mag)),
x AS (SELECT *, CASE WHEN hi > lo THEN (m - mean) / sd END AS z, CASE WHEN dt > 0 THEN 1 / (dt * dt) END AS w, ceil(0.05 * n) AS tail,
        CASE WHEN m - mean > 2 * sd THEN 1 WHEN m - mean < -2 * sd THEN -1 ELSE 0 END AS s0, CASE WHEN m1 - mean > 2 * sd THEN 1 WHEN m1 - mean < -2 * sd THEN -1 ELSE 0 END AS s1,
        CASE WHEN m2 - mean > 2 * sd THEN 1 WHEN m2 - mean < -2 * sd THEN -1 ELSE 0 END AS s2 FROM b),
y AS (SELECT *, sum(z) OVER (PARTITION BY id ORDER BY t, mag ROWS UNBOUNDED PRECEDING) / n AS walk FROM x),
g AS (SELECT id, max(n) AS n, max(mean) AS mean, max(sd) AS sd, max(med) AS med,
        quantile_cont(m, 0.5) FILTER (WHERE up > n - tail) - quantile_cont(m, 0.5) FILTER (WHERE up <= tail) AS ends,
        avg(CASE WHEN abs(m - mean) > sd * sqrt(n / (n - 1)) THEN 1.0 ELSE 0.0 END) AS beyond, count(*) FILTER (WHERE s0 <> 0 AND s0 = s1 AND s0 = s2) AS runs,
        avg(w) AS w_mean, sum(w) AS w_sum, sum(w * dm * dm) AS w_dm, max(t) - min(t) AS len, regr_slope(m, t) AS slope, max(CASE WHEN dt > 0 THEN abs(dm / dt) END) AS steep,
        quantile_cont(abs(m - med), 0.5) AS mad, max(abs(m - med)) AS far, avg(CASE WHEN abs(m - med) < (hi - lo) / 20 THEN 1.0 ELSE 0.0 END) AS near,
        count(*) FILTER (WHERE back < 30 AND dm > 0) - count(*) FILTER (WHERE back < 30 AND dm <= 0) AS ups, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS q31,
        max(walk) - min(walk) AS rcs, avg(pow(z, 3)) AS skew, sum(pow(z, 4)) * pow((max(n) - 1) / max(n), 2) AS z4, sum(abs(m - mean)) AS sig, sum((m - mean) * (m - mean)) AS sig2, {_PLACES}
      FROM y GROUP BY id)
SELECT id, n, round(ends / 2, 5) AS Amplitude, round(beyond, 5) AS Beyond1Std, round(runs / nullif(n - 2, 0), 5) AS Con, round(w_mean * len * len * w_dm / nullif(sd * sd * w_sum * n * n, 0), 5) AS Eta_e,
  round((f60 - f40) / nullif(f95 - f5, 0), 5) AS FluxPercentileRatioMid20, round((f67 - f32) / nullif(f95 - f5, 0), 5) AS FluxPercentileRatioMid35, round((f75 - f25) / nullif(f95 - f5, 0), 5) AS FluxPercentileRatioMid50,
  round((f82 - f17) / nullif(f95 - f5, 0), 5) AS FluxPercentileRatioMid65, round((f90 - f10) / nullif(f95 - f5, 0), 5) AS FluxPercentileRatioMid80, round(slope, 5) AS LinearTrend, round(steep, 5) AS MaxSlope,
  round(mean, 5) AS Mean, round(sd / nullif(mean, 0), 5) AS Meanvariance, round(mad, 5) AS MedianAbsDev, round(near, 5) AS MedianBRP, round(ups / 30, 5) AS PairSlopeTrend, round(far / nullif(med, 0), 5) AS PercentAmplitude,
  round((f95 - f5) / nullif(med, 0), 5) AS PercentDifferenceFluxPercentile, round(q31, 5) AS Q31, round(rcs, 5) AS Rcs, round(skew, 5) AS Skew,
  round(CASE WHEN n > 3 THEN CAST(n AS DOUBLE) * (n + 1) / (CAST(n - 1 AS DOUBLE) * (n - 2) * (n - 3)) * z4 - 3 * pow(n - 1, 2) / (CAST(n - 2 AS DOUBLE) * (n - 3)) END, 5) AS SmallKurtosis,
  round(sd, 5) AS Std, round(sig / nullif(sqrt(n) * sqrt(sig2), 0), 5) AS StetsonK FROM g"""

_COLOUR = f"""
WITH {C}, {_ALIGNED}, s AS (SELECT *, count(*) OVER e AS n, avg(mag) OVER e AS m, avg(mag2) OVER e AS m2, stddev_pop(mag) OVER e AS sd, stddev_pop(mag2) OVER e AS sd2, mag - mag2 AS d FROM a WINDOW e AS (PARTITION BY id)),
p AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN sqrt(n / (n - 1)) * (mag - m) / sd END AS z1, CASE WHEN n > 1 AND sd2 > 0 THEN sqrt(n / (n - 1)) * (mag2 - m2) / sd2 END AS z2,
      t - lag(t) OVER o AS dt, d - lag(d) OVER o AS dc FROM s WINDOW o AS (PARTITION BY id ORDER BY t, mag)),
y AS (SELECT *, sign(z1 * z2) * sqrt(abs(z1 * z2)) AS j, CASE WHEN dt > 0 THEN 1 / (dt * dt) END AS w FROM p)
SELECT id, count(*) AS n, round(avg(d), 5) AS Color, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 5) AS Q31_color,
  round(avg(w) * pow(max(t) - min(t), 2) * sum(w * dc * dc) / nullif(var_pop(d) * sum(w) * max(n) * max(n), 0), 5) AS Eta_color, round(avg(j), 5) AS StetsonJ,
  round(avg(j) * sum(abs(z1)) / (sqrt(max(n)) * sqrt(sum(z1 * z1))) / 0.798, 5) AS StetsonL FROM y GROUP BY id"""
_nudged = lambda sql: sql.replace("round(", f"round({NUDGE} + ")
_BOTH = f"(SELECT id FROM c WHERE band IN ('{FIRST}', '{SECOND}') GROUP BY id HAVING count(DISTINCT band) = 2)"
_TILE = _FEATURES.replace("  FROM c WINDOW", f"  FROM (SELECT * FROM c WHERE band = '{FIRST}' AND id IN {_BOTH}) c WINDOW")

ORACLE_SQL = {
    "phase_fold": f"WITH {C} SELECT id, key, round(fmod(t, {PERIOD}) / {PERIOD}, 6) AS phase, mag FROM c",
    "grid_resolution": f"WITH {C}, n AS (SELECT count(*) AS n FROM c GROUP BY id) SELECT quantile_cont(n, 0.5) AS resolution FROM n",
    "interpolate_grid": _grid_sql("coalesce(avg(mag) FILTER (WHERE d = 0), sum(mag / d) FILTER (WHERE d > 0) / sum(1 / d) FILTER (WHERE d > 0))"),
    "interpolate_grid_uniform": _grid_sql("avg(mag)"),
    "noise_filter": f"WITH {C}, s AS (SELECT id, avg(mag) AS m, stddev_pop(mag) AS sd FROM c GROUP BY id) SELECT id, key, mag FROM c JOIN s USING (id) WHERE abs(mag - m) <= 5 * sd",
    "band_full_outer": f"WITH {C}, n AS (SELECT id, count(*) FILTER (WHERE band = '{FIRST}') AS n_first, count(*) FILTER (WHERE band = '{SECOND}') AS n_second FROM c WHERE band IN ('{FIRST}', '{SECOND}') GROUP BY id) SELECT id, n_first, n_second, CAST(CASE WHEN n_second = 0 THEN 1 WHEN n_first = 0 THEN 2 ELSE 0 END AS BIGINT) AS present FROM n",
    "band_align": f"WITH {C}, {_ALIGNED} SELECT id, round(t, 6) AS t, round(mag, 6) AS mag, round(t2, 6) AS t2, round(mag2, 6) AS mag2 FROM a",
    "lc_features": _FEATURES,
    "lc_colour_features": _COLOUR,
    "lc_order_features": f"""
WITH {C}, x AS (SELECT id, t, mag, count(*) OVER e AS n, avg(mag) OVER e AS m, stddev_pop(mag) OVER e AS sd, row_number() OVER (PARTITION BY id ORDER BY mag, t) AS up, row_number() OVER (PARTITION BY id ORDER BY t, mag) AS r FROM c WINDOW e AS (PARTITION BY id)),
y AS (SELECT *, mag - m AS y, abs(mag - m) / sd / sqrt(2) AS a, 1 / (1 + 0.3275911 * (abs(mag - m) / sd / sqrt(2))) AS k FROM x WHERE sd > 0),
z AS (SELECT *, 1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-a * a) AS erf FROM y),
p AS (SELECT *, greatest(least(CASE WHEN y >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END, 1 - 1e-9), 1e-9) AS p FROM z),
ad AS (SELECT id, max(n) AS n, -max(n) - sum((2 * up - 1) * ln(p) + (2 * n - 2 * up + 1) * ln(1 - p)) / max(n) AS a2, sum(y * y) AS yy FROM p GROUP BY id),
ac AS (SELECT l.id, r.r - l.r AS k, sum(l.y * r.y) / any_value(yy) AS v FROM y l JOIN y r ON l.id = r.id AND r.r BETWEEN l.r + 1 AND l.r + 100 JOIN ad ON ad.id = l.id GROUP BY l.id, r.r - l.r),
f AS (SELECT id, min(k) AS k FROM ac WHERE v < exp(-1) GROUP BY id)
SELECT ad.id, n, round(1 / (1 + exp(-10 * (a2 - 0.3))), 5) AS AndersonDarling, f.k AS Autocor_length FROM ad LEFT JOIN f USING (id)""",
    "lc_folded_features": f"""
WITH {C}, o AS (SELECT id, t, mag, fmod(t, {PERIOD}) / {PERIOD} AS phase FROM c),
x AS (SELECT *, count(*) OVER e AS n, avg(mag) OVER e AS m, stddev_pop(mag) OVER e AS sd, mag - lag(mag) OVER (PARTITION BY id ORDER BY phase, t) AS dm FROM o WINDOW e AS (PARTITION BY id)),
y AS (SELECT *, sum((mag - m) / sd) OVER (PARTITION BY id ORDER BY phase, t ROWS UNBOUNDED PRECEDING) / n AS walk FROM x WHERE sd > 0)
SELECT id, round(max(walk) - min(walk), 5) AS Psi_CS, round(sum(dm * dm) / (max(n - 1) * max(sd * sd)), 5) AS Psi_eta FROM y GROUP BY id""",
    "lc_period": f"""
WITH {C}, s AS (SELECT id, avg(mag) AS m, var_pop(mag) AS v, min(t) AS t0 FROM c GROUP BY id),
o AS (SELECT c.id, t - t0 AS t, mag - m AS y FROM c JOIN s USING (id)),
f AS (SELECT f, 2 * pi() * (0.05 + f * (0.95 / 95)) AS w FROM range(96) r(f)),
p AS (SELECT id, f, sum(y * cos(w * t)) AS yc, sum(y * sin(w * t)) AS ys, sum(cos(w * t) * cos(w * t)) AS cc, sum(sin(w * t) * sin(w * t)) AS ss, sum(cos(w * t) * sin(w * t)) AS cs FROM o, f GROUP BY id, f),
a AS (SELECT *, atan2(2 * cs, cc - ss) / 2 AS r FROM p),
b AS (SELECT id, f, yc * cos(r) + ys * sin(r) AS yc, ys * cos(r) - yc * sin(r) AS ys, cc * cos(r) * cos(r) + 2 * cs * cos(r) * sin(r) + ss * sin(r) * sin(r) AS cc, cc * sin(r) * sin(r) - 2 * cs * cos(r) * sin(r) + ss * cos(r) * cos(r) AS ss FROM a),
w AS (SELECT id, f, CASE WHEN v > 0 THEN (CASE WHEN cc > 1e-9 THEN yc * yc / cc ELSE 0 END + CASE WHEN ss > 1e-9 THEN ys * ys / ss ELSE 0 END) / (2 * v) ELSE 0 END AS power FROM b JOIN s USING (id)),
k AS (SELECT id, f, power, row_number() OVER (PARTITION BY id ORDER BY power DESC, f) AS r FROM w)
SELECT id, round(1 / (0.05 + f * (0.95 / 95)), 5) AS period, round(power, 5) AS power FROM k WHERE r = 1""",
    "lc_period_fit": f"""
WITH {C}, s AS (SELECT id, avg(mag) AS m, var_pop(mag) AS v, min(t) AS t0 FROM c GROUP BY id),
o AS (SELECT c.id, t - t0 AS t, mag - m AS y FROM c JOIN s USING (id)),
f AS (SELECT f, 2 * pi() * (0.05 + f * (0.95 / 95)) AS w FROM range(96) r(f)),
p AS (SELECT id, f, sum(y * cos(w * t)) AS yc, sum(y * sin(w * t)) AS ys, sum(cos(w * t) * cos(w * t)) AS cc, sum(sin(w * t) * sin(w * t)) AS ss, sum(cos(w * t) * sin(w * t)) AS cs FROM o, f GROUP BY id, f),
a AS (SELECT *, atan2(2 * cs, cc - ss) / 2 AS r FROM p),
b AS (SELECT id, f, yc * cos(r) + ys * sin(r) AS yc, ys * cos(r) - yc * sin(r) AS ys, cc * cos(r) * cos(r) + 2 * cs * cos(r) * sin(r) + ss * sin(r) * sin(r) AS cc, cc * sin(r) * sin(r) - 2 * cs * cos(r) * sin(r) + ss * cos(r) * cos(r) AS ss FROM a),
w AS (SELECT id, f, CASE WHEN v > 0 THEN (CASE WHEN cc > 1e-9 THEN yc * yc / cc ELSE 0 END + CASE WHEN ss > 1e-9 THEN ys * ys / ss ELSE 0 END) / (2 * v) ELSE 0 END AS power FROM b JOIN s USING (id)),
k AS (SELECT id, f, power, row_number() OVER (PARTITION BY id ORDER BY power DESC, f) AS r FROM w)
SELECT id, round(1 / (0.05 + f * (0.95 / 95)), 4) AS PeriodLS, round(1 - pow(1 - exp(-power), 96), 4) AS Period_fit FROM k WHERE r = 1""",
    "lc_tile_closed": f"SELECT f.* EXCLUDE (n), g.Color, g.Q31_color, g.StetsonJ, g.StetsonL FROM ({_nudged(_TILE)}) f LEFT JOIN ({_nudged(_COLOUR)}) g USING (id)",
    "lc_slotted": f"""
WITH {C}, s AS (SELECT id, avg(mag) AS m, stddev_pop(mag) AS sd, count(*) AS n, max(t) > min(t) AS moves FROM c GROUP BY id),
o AS (SELECT c.id, t, mag - m AS y, row_number() OVER (PARTITION BY c.id ORDER BY t, mag) AS r FROM c JOIN s USING (id) WHERE n > 2 AND sd > 0 AND moves),
p AS (SELECT l.id, CAST(floor(r.t - l.t + 0.5) AS BIGINT) AS k, avg(l.y * r.y) AS v FROM o l JOIN o r ON l.id = r.id AND r.r >= l.r AND r.t - l.t < 19.5 GROUP BY l.id, 2),
z AS (SELECT id, v AS v0 FROM p WHERE k = 0), f AS (SELECT p.id, min(k) AS k FROM p JOIN z USING (id) WHERE v / v0 < exp(-1) GROUP BY p.id)
SELECT s.id, CAST(f.k AS DOUBLE) AS SlottedA_length FROM s LEFT JOIN f USING (id)""",
    "lc_selected": f"SELECT id, Mean, Std, Skew FROM ({_FEATURES})",
    "curve_documents": f"WITH {C} SELECT id, count(*) AS n, round(min(t), 6) AS t_first, round(arg_min(mag, (t, mag)), 6) AS mag_first, round(max(t), 6) AS t_last, round(arg_max(mag, (t, mag)), 6) AS mag_last FROM c GROUP BY id",
    "curve_observations": f"WITH {C} SELECT id, count(*) AS n, round(sum(mag), 4) AS mag FROM c GROUP BY id",
    "observation_counts": f"WITH {C} SELECT id, band, count(*) AS n FROM c GROUP BY id, band",
}
