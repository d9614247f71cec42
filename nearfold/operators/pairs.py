"""Pairs of a table, in tiles: closest and farthest pair, histogram, pairs within a distance.

Rows fall into blocks by a hash of the id; two blocks meet in one task of bounded size, which returns
only what it has found.  Where a largest distance is known, rows are first dealt into bands of
that width by their distance to one fixed row: by the triangle inequality pairs within it lie in
the same or neighbouring bands, and only their blocks meet.  The closest pair is sought within
blocks first; what is found there is the largest distance for the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, doubles
from ..shared import staged
from .blocks import distances, matrix, paired, squares
from .sums import column_sums
from .trees import located, sampled_tree

TILE, SLICE, OUTER = 16_384, 512, 1_024
BLOCK_ROWS, MOST_ROWS, LEAF_ROWS, SPANS = 4_096, 32_768, 32, 16_384
FEW_BINS, EMPTY = 24, (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tiles(rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, tile: int = TILE) -> DataFrame:
    """``work(left, right, same)`` on every pair of blocks of rows (id, vec)."""
    blocks = max(1, -(-rows.count() // tile))
    base = rows.select("id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    spread = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = key
        pdf = pdf.sort_values("id")
        return work(pdf[pdf.own == x], pdf[pdf.own == y], x == y)

    return spread.drop("other").groupBy("x", "y").applyInPandas(run, schema)


def band_tiles(rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, width: float, metric: str = "euclidean", tile: int = TILE) -> DataFrame:
    """``work(left, right, same)`` on all blocks that can hold pairs at most ``width`` apart.

    ``metric`` must obey the triangle inequality.  A band of many rows has as many blocks as it needs.
    """
    fixed = rows.select(doubles("vec").alias("vec")).first()
    if fixed is None:
        return rows.sparkSession.createDataFrame([], schema)
    far = METRICS[metric](doubles("vec"), F.array(*[F.lit(float(x)) for x in fixed.vec]))
    base = staged(rows.select("id", doubles("vec").alias("vec"), F.floor(far / (width * (1 + 1e-6) + 1e-6)).alias("band")), "bands")
    blocks = base.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    above, below = (blocks.select((F.col("band") - step).alias("band"), F.col("blocks").alias(name)) for step, name in ((1, "above"), (-1, "below")))
    base = base.join(blocks.join(above, "band", "left").join(below, "band", "left"), "band")
    base = base.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    none = F.array().cast("array<int>")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none)
    meet = lambda b1, x, b2, y: F.struct(b1.alias("b1"), x.alias("x"), b2.alias("b2"), y.alias("y"))
    band, own = F.col("band"), F.col("own")
    partners = F.concat(
        F.transform(every("blocks"), lambda s: meet(band, F.least(own, s), band, F.greatest(own, s))),
        F.transform(every("above"), lambda s: meet(band, own, band + 1, s)),
        F.transform(every("below"), lambda s: meet(band - 1, s, band, own)),
    )
    spread = base.select("id", "vec", "band", "own", F.explode(partners).alias("m")).select("id", "vec", "band", "own", "m.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b1, x, b2, y = key
        pdf = pdf.sort_values("id")
        return work(pdf[(pdf.band == b1) & (pdf.own == x)], pdf[(pdf.band == b2) & (pdf.own == y)], (b1, x) == (b2, y))

    return spread.groupBy("b1", "x", "b2", "y").applyInPandas(run, schema)


def _extreme(left: pd.DataFrame, right: pd.DataFrame, same: bool, metric: str, closest: bool) -> tuple[int, int, float] | None:
    """(a, b, dist) of the closest or farthest pair of two sets of rows sorted by id; ties by ids.

    Products of matrices show which pairs of a slice can be better than the best so far; only those are measured.
    """
    if not len(left) or not len(right):
        return None
    best, i, j = None, left.id.to_numpy(), right.id.to_numpy()
    order = lambda r: (np.isnan(r[2]), r[2] if closest else -r[2], r[0], r[1])
    x, y = np.stack(left.vec), np.stack(right.vec)
    for a in range(0, len(x), SLICE):
        for b in range(0, len(y), SLICE):
            if same and i[a] > j[min(b + SLICE, len(j)) - 1]:
                continue
            ids, others = i[a : a + SLICE], j[b : b + SLICE]
            d, off = squares(x[a : a + SLICE], y[b : b + SLICE]) if metric != "manhattan" else (distances(x[a : a + SLICE], y[b : b + SLICE], metric), 0.0)
            if same and ids[-1] >= others[0]:
                d[ids[:, None] >= others[None, :]] = np.inf if closest else -np.inf
            limit = d.min() if closest else d.max()
            if best is not None:  # distances agree to nine decimals: what may round to the best so far
                own = best[2] if metric == "manhattan" else best[2] ** 2 if metric == "euclidean" else best[2]
                limit = min(limit, own) if closest else max(limit, own)
            room = 2 * off + 1e-8 * (1 + abs(limit) ** 0.5) + 1e-18
            if np.isfinite(off) and not np.isfinite(limit):
                continue  # no pair
            if not np.isfinite(off):  # components that are no numbers or too large: every pair is measured
                u, v = np.nonzero(ids[:, None] < others[None, :] if same else np.ones(d.shape, bool))
            else:
                u, v = np.nonzero(d <= limit + room if closest else d >= limit - room)
            for at in range(0, len(u), 65_536):
                p, q = u[at : at + 65_536], v[at : at + 65_536]
                far = paired(x[a + p], y[b + q], metric).round(9)
                least, most = np.minimum(ids[p], others[q]), np.maximum(ids[p], others[q])
                one = np.lexsort([most, least, far if closest else -far])[0]
                found = (int(least[one]), int(most[one]), float(far[one]))
                best = found if best is None else min(best, found, key=order)
    return best


def _grid(left: pd.DataFrame, right: pd.DataFrame, same: bool, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of both sides and the distances of all pairs in order of ids, each once."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    d = distances(np.stack(left.vec), np.stack(right.vec), metric)
    a, b = np.broadcast_arrays(left.id.to_numpy()[:, None], right.id.to_numpy()[None, :])
    on = a < b if same else np.ones_like(d, bool)
    a, b, d = a[on], b[on], d[on]
    return np.minimum(a, b), np.maximum(a, b), d.round(9)


def _outer(rows: DataFrame, metric: str, widest: Callable[[DataFrame], float | None]) -> DataFrame:
    """The rows that can be in the farthest pair: no pair is farther apart than both are from the mean, together.

    The farthest pair among the ``OUTER`` rows that are farthest from the mean is a bound from below.
    """
    own, plain = rows.select("id", doubles("vec").alias("vec")), "euclidean" if metric == "sq_euclidean" else metric
    mean = [r.m for r in column_sums(own).orderBy("pos").select((F.col("s") / F.col("n")).alias("m")).collect()]
    if not mean:
        return own
    far = METRICS[plain](F.col("vec"), F.array(*[F.lit(float(x)) for x in mean]))
    own = staged(own.withColumn("far", far), "from_mean")
    bound, most = widest(own.orderBy(F.desc("far"), "id").limit(OUTER)), own.agg(F.max("far")).first()[0]
    if bound is None:
        return own.select("id", "vec")
    bound = bound**0.5 if metric == "sq_euclidean" else bound
    return own.filter(F.col("far") >= bound - most - 1e-6).select("id", "vec")


def extreme_pair(rows: DataFrame, closest: bool = True, metric: str = "euclidean", tile: int = TILE) -> DataFrame:
    """(a, b, dist) of the closest (or farthest) pair; ties by ids."""

    def work(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        found = _extreme(left, right, same, metric, closest)
        return pd.DataFrame([found] if found else [], columns=["a", "b", "dist"]).astype({"a": "int64", "b": "int64", "dist": "float64"})

    schema = "a long, b long, dist double"
    order = F.col("dist") if closest else F.desc("dist")
    if not closest:
        rows = _outer(rows, metric, lambda some: tiles(some, work, schema, tile).agg(F.max("dist")).first()[0])
    if not closest or metric == "sq_euclidean":
        return tiles(rows, work, schema, tile).orderBy(order, "a", "b").limit(1)
    blocks = max(1, -(-rows.count() // tile))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own")
    within = rows.select("id", doubles("vec").alias("vec"), own).groupBy("own").applyInPandas(lambda pdf: work(pdf.sort_values("id"), pdf.sort_values("id"), True), schema)
    bound = within.agg(F.min("dist")).first()[0]
    found = tiles(rows, work, schema, tile) if bound is None else band_tiles(rows, work, schema, bound, metric, tile)
    return found.orderBy(order, "a", "b").limit(1)


def pairs_within(rows: DataFrame, radius: float, metric: str = "euclidean", tile: int = OUTER) -> DataFrame:
    """(a, b, dist) of all pairs at most ``radius`` apart."""

    def work(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b, d = _grid(left, right, same, metric)
        on = d <= radius
        return pd.DataFrame({"a": a[on], "b": b[on], "dist": d[on]})

    if metric == "sq_euclidean":
        return tiles(rows, work, "a long, b long, dist double", tile)
    return band_tiles(rows, work, "a long, b long, dist double", radius, metric, tile)


# --- histogram by boxes ---------------------------------------------------------------------


def pair_histogram(rows: DataFrame, width: float, metric: str = "euclidean") -> DataFrame:
    """(bin, n): pairs of rows by floor(distance / width)."""
    return pair_bins(rows, width, metric).filter("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n"))


def pair_bins(rows: DataFrame, width: float, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """(bin, n) in parts, and under bin -1 how many pairs were measured.

    Rows fall into blocks by a tree that halves a sample.  Two blocks whose boxes' least and greatest
    distance are in one bin are counted whole, without their rows; the others meet, and there each is
    halved on, and halves are counted whole, until leaves of ``LEAF_ROWS`` are left to be measured.
    """
    spark, n = rows.sparkSession, rows.count()
    block_rows = block_rows or min(MOST_ROWS, max(BLOCK_ROWS, n // 24))  # a row goes along once for each block, so large tables take large ones
    own = located(rows, sampled_tree(rows, max(0, (n // block_rows).bit_length())))
    parts = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).alias("parts"))
    own = own.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).select("id", "vec", F.xxhash64("cell", "part").alias("block"))
    own = staged(own, "blocks")
    found = column_sums(own, "block").toPandas().sort_values(["grp", "pos"])  # a row per block and component
    names = found["grp"].unique()
    if not len(names):
        return spark.createDataFrame([], "bin long, n long")
    low, high = (found[c].to_numpy().reshape(len(names), -1) for c in ("low", "high"))
    held = spark.sparkContext.broadcast((names, found["n"].to_numpy().reshape(len(names), -1)[:, 0], low, high))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, low, high = held.value
        for batch in batches:
            for x in batch.column(0).to_pylist():
                y = np.arange(x + 1, len(ids))
                first, last = _span(low[[x]], high[[x]], low[y], high[y], width, metric)
                one = first == last
                bins, which = np.unique(first[one], return_inverse=True)
                count = np.bincount(which, (size[x] * size[y[one]]).astype(np.float64), len(bins)).astype(np.int64)
                meet = np.r_[x, y[~one]]
                none = [None] * len(meet)
                yield pa.RecordBatch.from_arrays([
                    pa.array([*bins.tolist(), *none], pa.int64()), pa.array([*count.tolist(), *none], pa.int64()),
                    pa.array([None] * len(bins) + [int(ids[x])] * len(meet), pa.int64()), pa.array([None] * len(bins) + ids[meet].tolist(), pa.int64()),
                ], ["bin", "n", "x", "y"])

    planned = spark.range(len(names)).repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(plan, "bin long, n long, x long, y long")
    planned = staged(planned, "planned")
    pairs = planned.filter("x IS NOT NULL").select("x", "y")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))

    def measure(key: tuple, both: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        block, v = both["block"].to_numpy(), matrix(both["vec"].combine_chunks())
        bins = _dual(_Boxes(v[block == x]), None if x == y else _Boxes(v[block == y]), width, metric)
        return pa.table([pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], ["bin", "n"])

    measured = sides.join(own.select("block", "vec"), "block").groupBy("x", "y").applyInArrow(measure, "bin long, n long")
    return planned.filter("bin IS NOT NULL").select("bin", "n").unionByName(measured)


def _span(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, width: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the least and the greatest distance of boxes, with room for rounding."""
    gap = np.maximum(np.maximum(low2 - high, low - high2), 0)
    reach = np.maximum(high2 - low, high - low2)
    size = lambda x: x.sum(1) if metric == "manhattan" else (x * x).sum(1) if metric == "sq_euclidean" else np.sqrt((x * x).sum(1))
    a, b = size(gap), size(reach)
    return (np.floor(np.maximum(a - 1e-8 * (1 + a), 0) / width)).astype(np.int64), (np.floor((b + 1e-8 * (1 + b)) / width)).astype(np.int64)


class _Boxes:
    """Rows in an order in which every node of a tree of halves is a stretch, and the nodes' boxes."""

    def __init__(self, x: np.ndarray) -> None:
        order, todo = np.arange(len(x)), [(0, len(x), -1, 0)]
        begin, end, child, low, high = [], [], [], [], []
        while todo:
            a, z, parent, side = todo.pop()
            at = len(begin)
            if parent >= 0:
                child[parent][side] = at
            own = x[order[a:z]]
            begin.append(a)
            end.append(z)
            child.append([-1, -1])
            low.append(own.min(0))
            high.append(own.max(0))
            axis = int((high[-1] - low[-1]).argmax())
            if z - a > LEAF_ROWS and high[-1][axis] > low[-1][axis]:
                half = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(own[:, axis], half)]
                todo += [(a + half, z, at, 1), (a, a + half, at, 0)]
        self.x, self.begin, self.end = x[order], np.array(begin), np.array(end)
        self.child, self.low, self.high = np.array(child), np.array(low), np.array(high)


def _dual(a: _Boxes, b: _Boxes | None, width: float, metric: str) -> Counter:
    """Pairs by bin between two sets of rows, or within one; -1: pairs that were measured."""
    out: Counter = Counter()
    one, b = b is None, b or a
    i, j, ends = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(i):
        spans = [_span(a.low[i[c]], a.high[i[c]], b.low[j[c]], b.high[j[c]], width, metric) for c in (slice(at, at + SPANS) for at in range(0, len(i), SPANS))]
        first, last = (np.concatenate([x[side] for x in spans]) for side in (0, 1))
        n, m = a.end[i] - a.begin[i], b.end[j] - b.begin[j]
        count = np.where(i == j, n * (n - 1) // 2, n * m) if one else n * m
        same = first == last
        for k, c in zip(first[same].tolist(), count[same].tolist(), strict=True):
            out[k] += c
        i, j, n, m = (v[~same] for v in (i, j, n, m))
        leaf = (a.child[i, 0] < 0) & (b.child[j, 0] < 0)
        ends.append((i[leaf], j[leaf]))
        i, j, n, m = (v[~leaf] for v in (i, j, n, m))
        self_pair = (i == j) if one else np.zeros(len(i), bool)
        s = i[self_pair]
        by_a = ~self_pair & (a.child[i, 0] >= 0) & ((n >= m) | (b.child[j, 0] < 0))
        by_b = ~self_pair & ~by_a
        left = [a.child[s, 0], a.child[s, 1], a.child[s, 0], a.child[i[by_a], 0], a.child[i[by_a], 1], i[by_b], i[by_b]]
        right = [a.child[s, 0], a.child[s, 1], a.child[s, 1], j[by_a], j[by_a], b.child[j[by_b], 0], b.child[j[by_b], 1]]
        i, j = np.concatenate(left), np.concatenate(right)
    i, j = (np.concatenate([e[side] for e in ends]) if ends else np.zeros(0, np.int64) for side in (0, 1))
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    for leaves in np.split(np.arange(len(i)), np.flatnonzero(i[1:] != i[:-1]) + 1) if len(i) else []:
        u, others = i[leaves[0]], j[leaves]
        if one and (others == u).any():
            own, others = a.x[a.begin[u] : a.end[u]], others[others != u]
            _count(out, distances(own, own, metric)[np.triu_indices(len(own), 1)].round(9), width)
        own = a.x[a.begin[u] : a.end[u]]
        places = np.concatenate([np.arange(b.begin[v], b.end[v]) for v in others]) if len(others) else np.zeros(0, np.int64)
        for at in range(0, len(places), 2_048):
            _count_between(out, own, b.x[places[at : at + 2_048]], width, metric)
    return +out  # bins without pairs are none


def _count(out: Counter, d: np.ndarray, width: float) -> None:
    bins, many = np.unique(np.floor(d / width).astype(np.int64), return_counts=True)
    for k, c in zip(bins.tolist(), many.tolist(), strict=True):
        out[k] += c
    out[-1] += d.size


def _count_between(out: Counter, x: np.ndarray, y: np.ndarray, width: float, metric: str) -> None:
    """Pairs of two sets of rows by bin: by products of matrices, measured directly where a bin's border is near."""
    if metric != "euclidean":
        _count(out, distances(x, y, metric).round(9).ravel(), width)
        return
    d, off = squares(x, y)
    if not np.isfinite(off):
        _count(out, distances(x, y).round(9).ravel(), width)
        return
    low, high = np.sqrt(max(d.min(), 0)) // width, np.sqrt(max(d.max(), 0)) // width + 1
    if high - low <= FEW_BINS and 4 * off < (width / 4) ** 2 and width > 1e-6 * (1 + high * width):
        border = np.arange(low, high + 1) * width
        room = off + 4e-9 * border + 1e-17
        border *= border
        below, upto = ([np.count_nonzero(d < e) for e in edge] for edge in (border - room, border + room))
        for k, (a, z) in enumerate(zip(upto[:-1], below[1:], strict=True)):
            out[int(low) + k] += z - a
        u, v = (np.concatenate(x) for x in zip(*(np.nonzero((d >= e - r) & (d < e + r)) if z > a else EMPTY for e, r, a, z in zip(border, room, below, upto, strict=True)), strict=True))
        out[-1] += d.size - len(u)
        if len(u):
            _count(out, paired(x[u], y[v]).round(9), width)
        return
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    room = off / np.maximum(d, 1e-150) + 2e-9 if d.min() < 1e-3 else off / d.min() + 2e-9
    d /= width
    near = np.abs(d - np.rint(d)) <= room / width
    bins = d.astype(np.int64)
    if near.any():
        u, v = np.nonzero(near)
        bins[u, v] = np.floor(paired(x[u], y[v]).round(9) / width).astype(np.int64)
    low = int(bins.min())
    if bins.max() - low < 1_000_000:
        many = np.bincount((bins - low).ravel())
        for k in np.flatnonzero(many).tolist():
            out[k + low] += int(many[k])
    else:
        found, many = np.unique(bins, return_counts=True)
        for k, c in zip(found.tolist(), many.tolist(), strict=True):
            out[k] += c
    out[-1] += d.size
