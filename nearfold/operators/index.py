"""Pruned k nearest neighbours: cluster rings, vantage points and trees, axis-aligned cells.

Each takes queries (qid, vec) and returns the neighbours with the work they took.  ``exact`` bounds
hold for every k; the other rules prune harder and may lose neighbours.  Rings and vantage points are
tested where blocks of queries and rows meet.  Over trees and cells tasks plan the visits of
their queries from a broadcast index (the nodes of a tree), in two rounds: the
first sends a query where its neighbours are likely to be, which gives the k-th distance found there;
the second, with that distance as the bound, descends to all that may hold nearer ones, so visits that can't
help are never made.  Queries meet rows by cell (``meet``), and neither side goes through the driver.

Rings, vantage points and vantage trees take any metric that satisfies the triangle inequality: by
name, or as a function of two matrices.  Boxes take ``euclidean`` and ``manhattan``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.curves import fixed_hash
from ..functions.vectors import doubles
from ..shared import staged
from .blocks import Best, Metric, distances, matrix, names, paired, rounded
from .clusters import summary
from .knn import QUERY_SLICE, ROW_SLICE, ROWS_BLOCK, best_rows, grid, ranked
from .meet import meet
from .quantiles import quantiles
from .trees import SLACK, HalfTree, ShellTree, located

PLANNED = 4_000_000  # distances held at once while visits are planned
GATHERED = 65_536  # pairs measured at once

#: Takes queries and their bounds; returns the place of each visit's query and the added columns.
Plan = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list]]


def _planned(queries: DataFrame, added: str, plan: Plan, width: int) -> DataFrame:
    """``queries`` (qid, qvec, tau), each as often as ``plan`` says, with the columns that it adds.

    ``plan`` sees so few queries at a time that ``width`` numbers for each stay small.
    """
    q = queries.select("qid", "qvec", "tau")
    schema = T.StructType([*q.schema.fields, *T._parse_datatype_string(added).fields])
    step = max(1, PLANNED // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                place, columns = plan(matrix(part.column(1)), part.column(2).to_numpy())
                own = part.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, columns)], schema=_arrow(part, columns, schema.names))

    return q.mapInArrow(run, schema)


def _arrow(part: pa.RecordBatch, columns: list, all_names: list[str]) -> pa.Schema:
    return pa.schema([*(pa.field(n, t) for n, t in zip(all_names, [*part.schema.types, *(pa.array(c).type for c in columns)], strict=True))])


def _unbounded(queries: DataFrame) -> DataFrame:
    return queries.select("qid", doubles("vec").alias("qvec"), F.lit(float("inf")).alias("tau"))


def _bounded(asked: DataFrame, visits: DataFrame, rows: DataFrame, k: int, metric: Metric) -> DataFrame:
    """``asked`` (qid, qvec, tau) with ``tau`` lowered to the k-th distance that the visits find."""
    seen = meet(visits, rows, k, metric=metric).filter("id IS NOT NULL")
    kth = ranked(seen, k).groupBy("qid").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("qid", "kth")
    return asked.join(kth, "qid", "left").withColumn("tau", F.least("tau", F.coalesce("kth", "tau"))).drop("kth")


def _nearest(visits: DataFrame, rows: DataFrame, k: int, metric: Metric) -> DataFrame:
    return ranked(meet(visits, rows, k, metric=metric).filter("id IS NOT NULL").drop("work"), k)


def _joined(parts: list[tuple[np.ndarray, ...]], kinds: list) -> list[np.ndarray]:
    """Columns of the parts put together."""
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate(kinds)]


class ClusterIndex:
    """Members (cluster_id, id, vec, dist) and centres (cluster_id, vec); cluster_id joins both.

    About as many centres as the root of the number of rows keep both steps short, but there may be any number:
    queries meet centres and members in blocks, so neither goes through the driver and no visit is a row.
    """

    def __init__(self, members: DataFrame, centres: DataFrame, metric: Metric = "euclidean") -> None:
        self.metric = metric
        self.clusters = staged(summary(members).join(centres.select("cluster_id", doubles("vec").alias("centre")), "cluster_id"), "clusters")
        members = members.select(F.col("cluster_id").alias("cell"), "id", doubles("vec").alias("vec"), F.col("dist").alias("far"))
        self.members = members.join(self.clusters.select(F.col("cluster_id").alias("cell"), "centre", "size"), "cell")

    def bounds(self, queries: DataFrame, k: int, rule: str = "exact") -> DataFrame:
        """(qid, vec, tau, seeds): the bound of each query (qid, vec), and the closest clusters that hold k as (cluster_id, d).

        rule ``exact``: tau is the k-th least d(q, c) + d(x, c) over members of these clusters; kept are members
        with |d(x, c) - d(q, c)| <= tau.  ``disk``: tau is d(q, c) of the last of them.  ``memory``: going
        outwards, tau becomes d(q, c) + least d(x, c) where d(q, c) > tau.  Both keep members with d(x, c) > d(q, c) - tau.
        """
        near = ranked(_near(queries, self.clusters.select(F.col("cluster_id").alias("id"), F.col("centre").alias("vec")), k, self.metric), k)
        order = F.row_number().over(W.partitionBy("cell").orderBy("far", "id"))
        least = self.members.select("cell", "id", "far").withColumn("r", order).filter(F.col("r") <= k).groupBy("cell").agg(F.collect_list("far").alias("near"))
        held = self.clusters.select("cluster_id", "size", "nearest").join(least, F.col("cluster_id") == F.col("cell"))
        seeds = near.join(held, near["id"] == held["cluster_id"]).select("qid", "rank", F.col("dist").alias("d"), "cluster_id", "size", "nearest", "near")
        seeds = seeds.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < k)
        s = F.array_sort(F.collect_list(F.struct("rank", "d", "cluster_id", "nearest", "near")))
        tau = {
            "exact": lambda s: F.array_max(F.slice(F.array_sort(F.flatten(F.transform(s, lambda c: F.transform(c["near"], lambda x: c["d"] + x)))), 1, k)),
            "disk": lambda s: F.array_max(F.transform(s, lambda c: c["d"])),
            "memory": lambda s: F.aggregate(s, F.lit(0.0), lambda t, c: F.when(c["d"] > t, c["d"] + c["nearest"]).otherwise(t)),
        }[rule]
        seeds = seeds.groupBy("qid").agg(s.alias("s"))
        seeds = seeds.select("qid", tau(F.col("s")).alias("tau"), F.transform("s", lambda c: F.struct(c["cluster_id"].alias("cluster_id"), c["d"].alias("d"))).alias("seeds"))
        return staged(queries.select("qid", doubles("vec").alias("vec")).join(seeds, "qid"), "bounds")

    def _met(self, bounds: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run`` over every block of queries (qid, vec, tau) with every block of members; a cluster's stand together, if they are few."""
        cut = F.when(F.col("size") > ROWS_BLOCK // 2, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / (ROWS_BLOCK // 2)))).otherwise(F.lit(0))
        left, right = grid(bounds.select("qid", "vec", "tau"), self.members, dealt=F.xxhash64("cell", cut))
        return left.groupBy("part", "qpart").cogroup(right.groupBy("part", "qpart")).applyInArrow(run, schema)

    def knn(self, queries: DataFrame, k: int, rule: str = "exact") -> DataFrame:
        """(qid, id, dist, rank): the ring of a query in a cluster is measured, and within a block only what its
        k-th distance so far leaves of it (``exact``)."""
        metric = self.metric

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            qids, id_type, parts = left["qid"].combine_chunks(), right.schema.field("id").type, []
            if left.num_rows and right.num_rows:
                q, tau, block = matrix(left["vec"].combine_chunks()), left["tau"].to_numpy(), _Members(right)
                own = names(block.ids)
                for a in range(0, len(q), QUERY_SLICE):
                    best, some = Best(len(q[a : a + QUERY_SLICE]), k), slice(a, a + QUERY_SLICE)
                    for b in range(0, len(block.x), ROW_SLICE):
                        limit = np.minimum(tau[some], best.limit) if rule == "exact" else tau[some]
                        _measure(best, q[some], block.x[b : b + ROW_SLICE], own[b : b + ROW_SLICE], block.ring(q[some], limit, b, rule, metric), metric)
                    parts.append(best_rows(best, qids.slice(a, QUERY_SLICE), id_type))
            return pa.concat_tables(parts or [best_rows(Best(0, k), qids.slice(0, 0), id_type)])

        kinds = dict(queries.dtypes)["qid"], dict(self.members.dtypes)["id"]
        return ranked(self._met(self.bounds(queries, k, rule), run, f"qid {kinds[0]}, id {kinds[1]}, dist double"), k)

    def metrics(self, queries: DataFrame, k: int, rule: str = "exact") -> DataFrame:
        """(qid, step1, step2, n_clusters): distances to centres, distances to members, clusters read."""
        metric, kind, bounds = self.metric, dict(queries.dtypes)["qid"], self.bounds(queries, k, rule)

        def looked(left: pa.Table, right: pa.Table) -> pa.Table:
            n = np.zeros(left.num_rows, np.int64)
            if left.num_rows and right.num_rows:
                q, tau, block = matrix(left["vec"].combine_chunks()), left["tau"].to_numpy(), _Members(right)
                for a in range(0, len(q), QUERY_SLICE):
                    for b in range(0, len(block.x), ROW_SLICE):
                        n[a : a + QUERY_SLICE] += np.count_nonzero(block.ring(q[a : a + QUERY_SLICE], tau[a : a + QUERY_SLICE], b, rule, metric), axis=1)
            return pa.table([left["qid"].combine_chunks(), pa.array(n)], ["qid", "n"])

        def reached(left: pa.Table, right: pa.Table) -> pa.Table:
            n = np.zeros(left.num_rows, np.int64)
            if left.num_rows and right.num_rows:
                q, tau, c = matrix(left["vec"].combine_chunks()), left["tau"].to_numpy(), matrix(right["vec"].combine_chunks())
                for a in range(0, len(q), QUERY_SLICE):
                    for b in range(0, len(c), ROW_SLICE):
                        gap = right["radius"].to_numpy()[None, b : b + ROW_SLICE] + tau[a : a + QUERY_SLICE, None] - rounded(q[a : a + QUERY_SLICE], c[b : b + ROW_SLICE], metric)
                        n[a : a + QUERY_SLICE] += np.count_nonzero(gap >= -SLACK if rule == "exact" else gap > 0, axis=1)
            return pa.table([left["qid"].combine_chunks(), pa.array(n)], ["qid", "n"])

        step1 = self.clusters.count()
        step2 = self._met(bounds, looked, f"qid {kind}, n long").groupBy("qid").agg(F.sum("n").alias("step2"))
        left, right = grid(bounds.select("qid", "vec", "tau"), self.clusters.select(F.col("cluster_id").alias("id"), F.col("centre").alias("vec"), "radius"))
        read = left.groupBy("part", "qpart").cogroup(right.groupBy("part", "qpart")).applyInArrow(reached, f"qid {kind}, n long").groupBy("qid").agg(F.sum("n").alias("reached"))
        # the closest clusters are read, reached or not
        seeds = bounds.select("qid", "tau", F.inline("seeds")).join(self.clusters.select("cluster_id", "radius"), "cluster_id")
        gap = F.col("radius") + F.col("tau") - F.col("d")
        seeds = seeds.groupBy("qid").agg(F.count(F.when(~(gap >= -SLACK) if rule == "exact" else ~(gap > 0), 1)).alias("more"))
        n = (F.coalesce("reached", F.lit(0)) + F.col("more")).alias("n_clusters")
        return seeds.join(read, "qid", "left").join(step2, "qid", "left").select("qid", F.lit(step1).cast("long").alias("step1"), F.coalesce("step2", F.lit(0)).alias("step2"), n)


class _Members:
    """A block of members, sorted by cluster, with the centres of its clusters."""

    def __init__(self, rows: pa.Table) -> None:
        cell = names(rows["cell"])
        by = np.argsort(cell, kind="stable")
        cell = cell[by]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.place = np.cumsum(np.r_[False, cell[1:] != cell[:-1]])
        self.ids, self.far = rows["id"].combine_chunks().take(pa.array(by)), rows["far"].to_numpy()[by]
        self.x = matrix(rows["vec"].combine_chunks())[by]
        self.centre = matrix(rows["centre"].combine_chunks().take(pa.array(by[first])))

    def ring(self, q: np.ndarray, tau: np.ndarray, at: int, rule: str, metric: Metric) -> np.ndarray:
        """Which of ``ROW_SLICE`` members from ``at`` on each query looks at."""
        place, far = self.place[at : at + ROW_SLICE], self.far[at : at + ROW_SLICE]
        d = rounded(q, self.centre[place[0] : place[-1] + 1], metric)[:, place - place[0]]
        if rule != "exact":
            return far > d - tau[:, None]
        d -= far
        return np.abs(d, out=d) <= tau[:, None] + SLACK


def _measure(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, on: np.ndarray, metric: Metric) -> None:
    """Adds to ``best`` the distances where ``on`` holds: one by one where these are few, else all at once."""
    many = np.count_nonzero(on)
    if many * 8 > on.size and not callable(metric):
        d = rounded(q, x, metric)
        d[~on] = np.inf
        best.add(d, ids)
    elif many:
        i, j = np.nonzero(on)
        for at in range(0, len(i), GATHERED):
            u, v = i[at : at + GATHERED], j[at : at + GATHERED]
            best.put(u, paired(q[u], x[v], metric).round(9), ids[v])


def _least(q: np.ndarray, x: np.ndarray, on: np.ndarray, metric: Metric) -> np.ndarray:
    """The least distance of each query to the rows where ``on`` holds."""
    if np.count_nonzero(on) * 8 > on.size and not callable(metric):
        return np.where(on, rounded(q, x, metric), np.inf).min(1)
    out, (i, j) = np.full(len(q), np.inf), np.nonzero(on)
    for at in range(0, len(i), GATHERED):
        u, v = i[at : at + GATHERED], j[at : at + GATHERED]
        np.minimum.at(out, u, paired(q[u], x[v], metric).round(9))
    return out


def _within(qfar: np.ndarray, far: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Where no vantage point tells a query and a row apart; points that rule out next to nothing end the search."""
    on, left = np.ones((len(qfar), len(far)), bool), len(qfar) * len(far)
    for j in range(far.shape[1]):
        on &= np.abs(qfar[:, [j]] - far[None, :, j]) <= limit
        if j % 4 == 3:
            was, left = left, np.count_nonzero(on)
            if left * 10 > was * 9 or not left:
                break
    return on


def _near(queries: DataFrame, rows: DataFrame, k: int, metric: Metric) -> DataFrame:
    """(qid, id, dist): of each block of ``rows`` (id, vec) the k nearest to each query (qid, vec)."""
    left, right = grid(queries.select("qid", doubles("vec").alias("vec")), rows)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, id_type, parts = left["qid"].combine_chunks(), right.schema.field("id").type, []
        if left.num_rows and right.num_rows:
            own, q, x = names(right["id"]), *(matrix(t["vec"].combine_chunks()) for t in (left, right))
            for a in range(0, len(q), QUERY_SLICE):
                best = Best(len(q[a : a + QUERY_SLICE]), k)
                for b in range(0, len(x), ROW_SLICE):
                    best.add(rounded(q[a : a + QUERY_SLICE], x[b : b + ROW_SLICE], metric), own[b : b + ROW_SLICE])
                parts.append(best_rows(best, qids.slice(a, QUERY_SLICE), id_type))
        return pa.concat_tables(parts or [best_rows(Best(0, k), qids.slice(0, 0), id_type)])

    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["id"]
    return left.groupBy("part", "qpart").cogroup(right.groupBy("part", "qpart")).applyInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, dist double")


def cost(metrics: DataFrame, dimensions: int, seek: float = 0.005, transfer: float = 128e6) -> DataFrame:
    """Averages over queries and the estimated seconds of disk work."""
    out = metrics.agg(F.avg("step1").alias("avg_step1"), F.avg("step2").alias("avg_step2"), F.avg("n_clusters").alias("avg_disk"))
    return out.withColumn("cost", F.col("avg_disk") * seek + F.col("avg_step2") * 4 * dimensions / transfer)


class VantageIndex:
    """Distances of every row to a few vantage points (id, vector), kept in one array column.

    Queries and rows meet in blocks, as without an index; in a block only pairs that the vantage points do
    not rule out are measured, a bounded number at a time, and only the k best of each query leave the task.
    """

    def __init__(self, rows: DataFrame, points: list[tuple[int, list[float]]], metric: Metric = "euclidean") -> None:
        self.pivots, self.metric = np.array([v for _, v in points], np.float64), metric
        self.rows = staged(self._far(rows, "id"), "vantage")

    def _far(self, rows: DataFrame, name: str) -> DataFrame:
        """(name, vec, far) with the distances to the vantage points."""
        pivots, metric = rows.sparkSession.sparkContext.broadcast(self.pivots), self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(matrix(batch.column(1)), pivots.value, metric).round(9) if batch.num_rows else np.zeros((0, len(pivots.value)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(far), pa.list_(pa.float64()))], [name, "vec", "far"])

        schema = f"{name} {dict(rows.dtypes)[name]}, vec array<double>, far array<double>"
        return rows.select(name, doubles("vec").alias("vec")).mapInArrow(run, schema)

    def _blocks(self, queries: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run`` over every block of queries with every block of rows."""
        left, right = grid(self._far(queries, "qid"), self.rows)
        return left.groupBy("part", "qpart").cogroup(right.groupBy("part", "qpart")).applyInArrow(run, schema)

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, dist): of each block of rows the k nearest to each query, exactly.

        Left out are rows with |d(v, x) - d(q, v)| for some v above the least over v of d(q, v) + the k-th least d(v, x) of
        the block, or above the k-th distance measured so far.
        """
        metric = self.metric

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            qids, id_type, parts = left["qid"].combine_chunks(), right.schema.field("id").type, []
            if left.num_rows and right.num_rows:
                own, q, x = names(right["id"]), *(matrix(t["vec"].combine_chunks()) for t in (left, right))
                qfar, far = (matrix(t["far"].combine_chunks()) for t in (left, right))
                near = np.partition(far, k - 1, axis=0)[k - 1] if len(far) >= k else np.full(far.shape[1], np.inf)
                for a in range(0, len(q), QUERY_SLICE):
                    qf = qfar[a : a + QUERY_SLICE]
                    upper, best = (qf + near).min(1), Best(len(qf), k)
                    for b in range(0, len(x), ROW_SLICE):
                        limit = np.minimum(upper, best.limit)[:, None] + SLACK
                        on = _within(qf, far[b : b + ROW_SLICE], limit)
                        _measure(best, q[a : a + QUERY_SLICE], x[b : b + ROW_SLICE], own[b : b + ROW_SLICE], on, metric)
                    parts.append(best_rows(best, qids.slice(a, QUERY_SLICE), id_type))
            return pa.concat_tables(parts or [best_rows(Best(0, k), qids.slice(0, 0), id_type)])

        kinds = dict(queries.dtypes)["qid"], dict(self.rows.dtypes)["id"]
        return self._blocks(queries, run, f"qid {kinds[0]}, id {kinds[1]}, dist double")

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        return ranked(self.candidates(queries, k), k)

    def filtered(self, queries: DataFrame, nearest: int) -> DataFrame:
        """(qid, candidates, least): how many rows have d(v, x) < 2 d(q, v) for the ``nearest`` points v to the
        query, and the least of their distances; queries without any are left out."""
        metric = self.metric

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            n, least = np.zeros(left.num_rows, np.int64), np.full(left.num_rows, np.inf)
            if left.num_rows and right.num_rows:
                q, x = (matrix(t["vec"].combine_chunks()) for t in (left, right))
                qfar, far = (matrix(t["far"].combine_chunks()) for t in (left, right))
                cut = np.sort(qfar, 1)[:, min(nearest, qfar.shape[1]) - 1]
                for a in range(0, len(q), QUERY_SLICE):
                    for b in range(0, len(x), ROW_SLICE):
                        qf, f = qfar[a : a + QUERY_SLICE], far[b : b + ROW_SLICE]
                        on = np.all([(qf[:, [j]] > cut[a : a + QUERY_SLICE, None]) | (f[None, :, j] < 2 * qf[:, [j]]) for j in range(f.shape[1])], axis=0)
                        n[a : a + QUERY_SLICE] += np.count_nonzero(on, axis=1)
                        own = least[a : a + QUERY_SLICE]
                        np.minimum(own, _least(q[a : a + QUERY_SLICE], x[b : b + ROW_SLICE], on, metric), out=own)
            return pa.table([left["qid"].combine_chunks(), pa.array(n), pa.array(least)], ["qid", "candidates", "least"])

        found = self._blocks(queries, run, f"qid {dict(queries.dtypes)['qid']}, candidates long, least double").filter("candidates > 0")
        return found.groupBy("qid").agg(F.sum("candidates").alias("candidates"), F.min("least").alias("least"))


class CellIndex:
    """Axis-aligned cells of a density or kd tree."""

    def __init__(self, rows: DataFrame, tree: dict, metric: str = "euclidean") -> None:
        if metric not in ("euclidean", "manhattan"):
            raise ValueError("boxes take euclidean and manhattan distances")
        self.tree, self.metric = tree, metric
        self.rows = staged(located(rows, tree).withColumn("far", F.lit(0.0)), "cells")

    def knn(self, queries: DataFrame, k: int, dimensions: int | None = None) -> DataFrame:
        """Exact: the first round searches the least part of the tree around the query that holds k rows, the
        second every cell whose box is within the k-th distance found."""
        return _nearest(self.visits(queries, k), self.rows, k, self.metric)

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, qvec, tau, cell, d, low, high) of the second round."""
        size = {r.cell: r["n"] for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf
        held, metric = queries.sparkSession.sparkContext.broadcast((HalfTree(self.tree), size)), self.metric

        def first(q: np.ndarray, _) -> tuple[np.ndarray, list]:
            tree, count = held.value
            parts = [(np.tile(rows, len(leaves)), np.repeat(tree.path[leaves], len(rows))) for leaves, rows in tree.home(q, k, count)]
            i, cell = _joined(parts, [np.int64, object])
            return i, [cell.astype(str), *np.zeros((3, len(i)))]

        def second(q: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, list]:
            tree, count = held.value
            parts = [(rows, np.full(len(rows), tree.path[leaf], object), gap) for leaf, rows, gap in tree.within(q, tau, metric) if count.get(tree.path[leaf])]
            i, cell, gap = _joined(parts, [np.int64, object, float])
            return i, [cell.astype(str), gap, *np.zeros((2, len(i)))]

        added, asked = "cell string, d double, low double, high double", _unbounded(queries)
        seeds = staged(_planned(asked, added, first, 256), "seeds")
        return staged(_planned(_bounded(asked, seeds, self.rows, k, metric), added, second, 256), "visits")


def median_tree(rows: DataFrame, dimensions: int, depth: int) -> dict:
    """A kd tree of exact medians, all nodes of a level at once."""
    root: dict = {}
    for level in range(depth):
        axis = level % dimensions
        own = located(rows, root).select("cell", doubles("vec")[axis].alias("x"))
        cuts = quantiles(own, F.col("cell"), F.col("x"), [0.5]).collect()  # a row per node
        for r in cuts:
            node = root
            for side in r.grp:
                node = node["right" if side == "1" else "left"]
            node |= {"axis": axis, "value": float(r.q[0]), "left": {}, "right": {}}
    return root


class VantageTree:
    """A tree of vantage points: each node cuts its rows into ``branching`` shells of equal counts around
    one of them (that of the least hash, or ``point`` at the root), each shell again, ``levels`` deep.

    Every leaf knows the least and greatest distance to each vantage point above it.  The driver holds a
    vantage point for every inner node.
    """

    def __init__(self, rows: DataFrame, branching: int, levels: int = 1, point: list[float] | None = None, metric: Metric = "euclidean") -> None:
        self.branching, self.levels, self.metric = branching, levels, metric
        self.pivots: dict[str, np.ndarray] = {}
        self.bounds: list[tuple[str, list[tuple[str, float, float]]]] = []
        kind = dict(rows.dtypes)["id"]
        own = rows.select("id", doubles("vec").alias("vec"), F.lit("").alias("cell"), F.lit(0.0).alias("far"))
        held: dict[str, list[tuple[str, float, float]]] = {"": []}
        for level in range(levels):
            if level == 0 and point is not None:
                found = {"": np.array(point, float)}
            else:
                picked = own.groupBy("cell").agg(F.min_by("vec", F.struct(fixed_hash(F.col("id")), "id")).alias("vec")).collect()  # a row per node
                found = {r.cell: np.array(r.vec) for r in picked}
            self.pivots |= found
            own = staged(own.mapInArrow(_to_pivots(found, metric), f"id {kind}, vec array<double>, cell string, far double"), "level")
            cuts = own.groupBy("cell").agg(F.percentile_approx("far", [i / branching for i in range(1, branching)], 10_000).alias("c")).collect()
            own = own.mapInArrow(_to_shells({r.cell: np.array(r.c) for r in cuts}), f"id {kind}, vec array<double>, cell string, far double")
            own = staged(own, "shells")
            below = own.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect()
            held = {r.cell: [*held[_above(r.cell)], (_above(r.cell), r.low, r.high)] for r in below}
        self.rows, self.bounds = own, sorted(held.items())

    def knn(self, queries: DataFrame, k: int) -> DataFrame:
        """Exact: the first round searches the least part of the tree around the query that holds k rows, the
        second every leaf whose shells all come within the k-th distance found of the query's own distances."""
        return _nearest(self.visits(queries, k), self.rows, k, self.metric)

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, qvec, tau, cell, d, low, high) of the second round."""
        size = {r.cell: r["n"] for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf
        held = queries.sparkSession.sparkContext.broadcast(ShellTree(self.pivots, self.bounds, size, self.metric))

        def columns(parts: list, tau: np.ndarray) -> tuple[np.ndarray, list]:
            i, cell, d = _joined(parts, [np.int64, object, float])
            return i, [cell.astype(str), d, d - tau[i] - SLACK, d + tau[i] + SLACK]

        def first(q: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, list]:
            tree, parts = held.value, []
            for node, rows in tree.home(q, k):
                found = tree.within(q, tau, node, rows) if node in tree.children else [(node, rows, tree.leaf_distance(q[rows], node))] if node else []
                parts += [(r, np.full(len(r), leaf, object), d) for leaf, r, d in found]
            return columns(parts, tau)

        def second(q: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, list]:
            tree = held.value
            return columns([(r, np.full(len(r), leaf, object), d) for leaf, r, d in tree.within(q, tau)] if tree.children else [], tau)

        added, asked = "cell string, d double, low double, high double", _unbounded(queries)
        seeds = staged(_planned(asked, added, first, 256), "seeds")
        return staged(_planned(_bounded(asked, seeds, self.rows, k, self.metric), added, second, 256), "visits")


def _above(path: str) -> str:
    return path.rpartition("/")[0]


def _to_pivots(pivots: dict[str, np.ndarray], metric: Metric):
    """Rows (id, vec, cell, far) with ``far`` the distance to their node's vantage point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, x = np.array(batch.column(2).to_pylist(), object), matrix(batch.column(1))
                far = np.zeros(len(x))
                for c in set(cell.tolist()):
                    on = cell == c
                    far[on] = distances(x[on], pivots[c][None], metric)[:, 0].round(9)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(far)], ["id", "vec", "cell", "far"])

    return run


def _to_shells(cuts: dict[str, np.ndarray]):
    """Rows (id, vec, cell, far) one level down: the shell's number after the cell's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [f"{c}/{int(np.searchsorted(cuts[c], f))}" for c, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.string()), batch.column(3)], ["id", "vec", "cell", "far"])

    return run
