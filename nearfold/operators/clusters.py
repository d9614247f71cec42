"""Clusters of vectors: nearest-centre assignment, and BIRCH in mergeable form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..shared import staged
from .blocks import Metric, distances, matrix, rounded
from .knn import ROWS_BLOCK, grid
from .trees import located, sampled_tree

CENTRE_BLOCK = 20_000
ROWS_SLICE, CENTRES_SLICE = 512, 4_096
CELL_FEATURES, CUTS = 20_000, (0.5, 0.3, 0.7)
FEATURE = "n long, ls array<double>, ss double"


def assign(rows: DataFrame, centres: DataFrame, metric: Metric = "euclidean") -> DataFrame:
    """(id, cluster_id, dist) of the nearest centre (cluster_id, vec); ties by cluster id.

    Up to ``CENTRE_BLOCK`` centres are one broadcast.  More stay out of the driver: rows and centres meet in blocks,
    and each block sends on the best of its centres for every row.
    """
    kind = dict(rows.dtypes)["id"]
    rows = rows.select("id", doubles("vec").alias("vec"))
    centres = centres.select(F.col("cluster_id").cast("long").alias("id"), doubles("vec").alias("vec")).orderBy("id")
    few = centres.limit(CENTRE_BLOCK + 1).toArrow()
    if few.num_rows <= CENTRE_BLOCK:
        block = rows.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), matrix(few["vec"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, c = block.value
            for batch in batches:
                if len(ids):
                    at, d = _nearest(matrix(batch.column(1)), c, metric)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at]), pa.array(d)], ["id", "cluster_id", "dist"])
                else:
                    none = pa.array(np.full(batch.num_rows, -1)), pa.array(np.full(batch.num_rows, np.inf))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *none], ["id", "cluster_id", "dist"])

        return rows.mapInArrow(run, f"id {kind}, cluster_id long, dist double")
    keyed = staged(rows.withColumn("qid", F.monotonically_increasing_id()), "keyed")  # ids may repeat
    left, right = grid(keyed, staged(centres, "centres"), queries_block=ROWS_BLOCK)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        at, d = np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            at, d = _nearest(matrix(left["vec"].combine_chunks()), matrix(right["vec"].combine_chunks()), metric)
        left = left.select(["qid", "id"]).slice(0, len(at))
        return left.append_column("cluster_id", right["id"].take(pa.array(at))).append_column("dist", pa.array(d))

    found = left.groupBy("part", "qpart").cogroup(right.groupBy("part", "qpart")).applyInArrow(best, f"qid long, id {kind}, cluster_id long, dist double")
    out = found.groupBy("qid").agg(F.min(F.struct("dist", "cluster_id", "id")).alias("m"))
    return out.select("m.id", "m.cluster_id", "m.dist")


def _nearest(x: np.ndarray, centre: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre of each row, the first of equal ones, and its distance to nine decimals."""
    at, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for a in range(0, len(x), ROWS_SLICE):
        for b in range(0, len(centre), CENTRES_SLICE):
            own = slice(a, a + ROWS_SLICE)
            d = rounded(x[own], centre[b : b + CENTRES_SLICE], metric)
            j = d.argmin(1)
            least = d[np.arange(len(d)), j]
            better = least < best[own]
            at[own], best[own] = np.where(better, j + b, at[own]), np.where(better, least, best[own])
    return at, best


class Birch:
    """BIRCH as mergeable sums: every task absorbs its rows into cluster features whose radius (or
    diameter) stays below the threshold, and the features of tasks are absorbed into each other.  What is
    passed on is features, never rows.  ``start`` continues earlier batches, and ``global_clusters`` puts the
    features together into a given number of clusters.

    A task takes rows by the block: each goes to its nearest feature in a tree, and all that stay with one
    feature are absorbed at once as far as its sums allow; the others go through the tree one by one, which splits
    as it grows.  Between tasks features fall into cells of about ``CELL_FEATURES`` by a tree that halves a sample of them,
    and merge within a cell; then into other cells, by trees that cut elsewhere (``CUTS``), so what a border kept
    apart meets in the next pass.  So tasks stay bounded, however many features there are.

    The result depends on the order, as BIRCH does; it always holds that every feature of more than
    one row is below the threshold and that the features add up to the data.
    """

    def __init__(self, threshold: float, distance: str = "d0", size: str = "r", branching: int = 50) -> None:
        self.threshold, self.distance, self.size, self.branching = threshold, distance, size, branching

    def fit(self, rows: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """(cluster_id, n, ls, ss); ``start`` holds the features of earlier batches."""
        one = F.aggregate(doubles("vec"), F.lit(0.0), lambda a, x: a + x * x)
        features = rows.select(F.lit(1).cast("long").alias("n"), doubles("vec").alias("ls"), one.alias("ss"))
        if start is not None:
            features = features.unionByName(start.select("n", "ls", "ss"))
        features = staged(features.mapInArrow(self._absorb(), FEATURE), "features")
        for cut in CUTS:
            depth = (features.count() // CELL_FEATURES).bit_length()
            centres = features.select(F.monotonically_increasing_id().alias("id"), F.transform("ls", lambda x: x / F.col("n")).alias("vec"), F.struct("n", "ls", "ss").alias("cf"))
            tree = sampled_tree(centres, depth, cut) if depth else {}
            cells = located(centres, tree, ["cf"]).select("cell", "cf.*") if tree else features.withColumn("cell", F.lit(""))
            merged = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(self._absorb(by_cell=True), FEATURE)
            features = staged(merged, "merged")
            if not tree:
                break
        return features.select(F.monotonically_increasing_id().alias("cluster_id"), "n", "ls", "ss")

    def _absorb(self, by_cell: bool = False):
        """Features (n, ls, ss) absorbed into each other; ``by_cell``: rows stand by a column ``cell``, and cells stay apart."""
        threshold, distance, size, branching = self.threshold, self.distance, self.size, self.branching

        def done(tree: CfTree) -> pa.RecordBatch:
            n, ls, ss = tree.leaves()
            return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(list(ls), pa.list_(pa.float64())), pa.array(ss)], ["n", "ls", "ss"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, last = None, ""
            for batch in batches:
                names = batch.schema.names
                n, ss = (batch.column(names.index(c)).to_numpy() for c in ("n", "ss"))
                ls = matrix(batch.column(names.index("ls")))
                cell = np.array(batch.column(names.index("cell")).to_pylist(), str) if by_cell else np.zeros(len(n), "U1")
                cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
                for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(n)], strict=True):
                    if a == z:
                        continue
                    if tree is not None and cell[a] != last:
                        yield done(tree)
                        tree = None
                    last, tree = cell[a], tree or CfTree(ls.shape[1], threshold, distance, size, branching)
                    tree.add_block(n[a:z], ls[a:z], ss[a:z])
            if tree is not None:
                yield done(tree)

        return run

    @staticmethod
    def centres(features: DataFrame) -> DataFrame:
        """(cluster_id, vec): centroids."""
        return features.select("cluster_id", F.transform("ls", lambda x: x / F.col("n")).alias("vec"))

    @staticmethod
    def global_clusters(features: DataFrame, number: int, seed: int = 7) -> DataFrame:
        """(cluster_id, global_id): features put together into at most ``number`` clusters, by k-means over
        centroids weighted by their rows."""
        points = Birch.centres(features).join(features.select("cluster_id", F.col("n").cast("double").alias("weight")), "cluster_id")
        points = points.select("cluster_id", "weight", array_to_vector("vec").alias("features"))
        if points.isEmpty():
            return points.select("cluster_id", F.lit(0).alias("global_id"))
        return KMeans(k=number, seed=seed, weightCol="weight", predictionCol="global_id").fit(points).transform(points).select("cluster_id", "global_id")

    def labels(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        """(id, cluster_id, dist): every row with its nearest centroid."""
        return assign(rows, self.centres(features))


class _Node:
    """Up to ``branching`` cluster features, and for an inner node the child below each."""

    def __init__(self, d: int, branching: int, inner: bool) -> None:
        self.k, self.n, self.ls, self.ss = 0, np.zeros(branching + 1), np.zeros((branching + 1, d)), np.zeros(branching + 1)
        self.children: list[_Node] | None = [] if inner else None

    def put(self, n: float, ls: np.ndarray, ss: float, child: _Node | None = None, at: int | None = None) -> None:
        """A feature at place ``at``, or at the end."""
        if at is None:
            at, self.k = self.k, self.k + 1
            if child is not None:
                self.children.append(child)
        elif child is not None:
            self.children[at] = child
        self.n[at], self.ls[at], self.ss[at] = n, ls, ss

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.k].sum(), self.ls[: self.k].sum(0), self.ss[: self.k].sum()


class CfTree:
    """A height-balanced tree of cluster features: a feature goes down along the nearest entries, is absorbed
    by the nearest one of a leaf if that stays below the threshold, and full nodes split around their two
    entries that are farthest apart."""

    def __init__(self, d: int, threshold: float, distance: str, size: str, branching: int) -> None:
        self.d, self.threshold, self.distance, self.branching = d, threshold, distance, branching
        self.scale = np.sqrt(2) if size == "d" else 1.0
        self.root = _Node(d, branching, False)

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        parts = self._add(self.root, n, ls, ss)
        if parts:
            self.root = _Node(self.d, self.branching, True)
            for p in parts:
                self.root.put(*p.total(), p)

    def add_block(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, rows: int = 512) -> None:
        """Many features at once: those whose nearest leaf entry can take them all are added to it in one step."""
        for at in range(0, len(n), rows):
            own = slice(at, at + rows)
            left = self._take(n[own], ls[own], ss[own]) if self.root.k else np.arange(len(n[own]))
            for i in left.tolist():
                self.add(n[own][i], ls[own][i], ss[own][i])

    def _take(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> np.ndarray:
        """Adds what leaf entries can take without splits; the places of what is left."""
        left, todo = [], [(self.root, np.arange(len(n)), [])]
        while todo:
            node, rows, above = todo.pop()
            centre = node.ls[: node.k] / node.n[: node.k, None]
            near = distances(ls[rows] / n[rows, None], centre, "manhattan" if self.distance == "d1" else "sq_euclidean").argmin(1)
            for e in np.unique(near).tolist():
                own = rows[near == e]
                if node.children is not None:
                    todo.append((node.children[e], own, [*above, (node, e)]))
                    continue
                many, total, square = node.n[e] + np.cumsum(n[own]), node.ls[e] + np.cumsum(ls[own], 0), node.ss[e] + np.cumsum(ss[own])
                within = np.sqrt(np.maximum(square / many - (total * total).sum(1) / many**2, 0)) * self.scale < self.threshold
                good = np.flatnonzero(within)
                if len(good):  # the longest run of rows after which the entry is below the threshold
                    m = good[-1] + 1
                    for up, x in [*above, (node, e)]:
                        up.put(up.n[x] + n[own[:m]].sum(), up.ls[x] + ls[own[:m]].sum(0), up.ss[x] + ss[own[:m]].sum(), at=x)
                    own = own[m:]
                left += own.tolist()
        return np.array(sorted(left), np.int64)

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, ls, ss) of the features at the leaves."""
        found, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.children is None:
                found.append((node.n[: node.k], node.ls[: node.k], node.ss[: node.k]))
            else:
                todo += node.children
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _far(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> tuple[np.ndarray, np.ndarray]:
        """Distance of a feature to each entry, and the squared radius of both together."""
        ns, lss, sss = node.n[: node.k], node.ls[: node.k], node.ss[: node.k]
        c, mine, merged_n = lss / ns[:, None], ls / n, ns + n
        merged = lss + ls
        within = np.maximum((sss + ss) / merged_n - (merged * merged).sum(1) / merged_n**2, 0)
        if self.distance == "d1":
            return np.abs(c - mine).sum(1), within
        if self.distance == "d2":
            return sss / ns + ss / n - 2 * (c @ mine), within
        if self.distance == "d3":
            return within, within
        apart = ((c - mine) ** 2).sum(1)
        return (apart * ns * n / merged_n if self.distance == "d4" else apart), within

    def _add(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> tuple[_Node, _Node] | None:
        """The two halves of the node, if it had to split."""
        if not node.k:
            node.put(n, ls, ss)
            return None
        far, within = self._far(node, n, ls, ss)
        at = int(far.argmin())
        if node.children is not None:
            parts = self._add(node.children[at], n, ls, ss)
            if parts is None:
                node.put(node.n[at] + n, node.ls[at] + ls, node.ss[at] + ss, at=at)
                return None
            node.put(*parts[0].total(), parts[0], at)
            node.put(*parts[1].total(), parts[1])
        elif np.sqrt(within[at]) * self.scale < self.threshold:
            node.put(node.n[at] + n, node.ls[at] + ls, node.ss[at] + ss, at=at)
            return None
        else:
            node.put(n, ls, ss)
        return self._split(node) if node.k > self.branching else None

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        c = node.ls[: node.k] / node.n[: node.k, None]
        apart = distances(c, c, "sq_euclidean")
        i, j = np.unravel_index(int(apart.argmax()), apart.shape)
        near = apart[:, i] <= apart[:, j]
        near[i], near[j] = True, False
        out = _Node(self.d, self.branching, node.children is not None), _Node(self.d, self.branching, node.children is not None)
        for e in range(node.k):
            out[0 if near[e] else 1].put(node.n[e], node.ls[e].copy(), node.ss[e], node.children[e] if node.children is not None else None)
        return out


def summary(members: DataFrame) -> DataFrame:
    """(cluster_id, size, radius, nearest): count, greatest and least distance of members (cluster_id, dist)."""
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.max("dist").alias("radius"), F.min("dist").alias("nearest"))


def grid_cells(rows: DataFrame, radius: float) -> DataFrame:
    """(cell, n) of hypercubes of side 2 * radius on the unit cube or beyond."""
    cell = F.concat_ws(",", F.transform(doubles("vec"), lambda x: F.floor(x / (2 * radius)).cast("string")))
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
