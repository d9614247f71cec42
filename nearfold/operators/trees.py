"""Trees as arrays, to descend with many queries at once: halves by a component, or shells around vantage points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import doubles
from .blocks import Metric, distances, matrix

SLACK = 1e-9
SAMPLE_ROWS = 16_384


class HalfTree:
    """Nested dictionaries (axis, value, left, right) as arrays by node; node 0 is the root, leaves have axis -1."""

    def __init__(self, tree: dict) -> None:
        axis, value, left, right, path, todo = [], [], [], [], [], [(tree, "", -1, 0)]
        while todo:
            node, name, parent, side = todo.pop()
            at = len(axis)
            if parent >= 0:
                (right if side else left)[parent] = at
            axis.append(node.get("axis", -1))
            value.append(node.get("value", 0.0))
            left.append(-1)
            right.append(-1)
            path.append(name)
            if "axis" in node:
                todo += [(node["right"], name + "1", at, 1), (node["left"], name + "0", at, 0)]
        self.axis, self.value, self.left, self.right = np.array(axis), np.array(value, float), np.array(left), np.array(right)
        self.path = np.array(path, object)
        n = len(axis)
        self.parent, self.stop = np.full(n, -1), np.arange(1, n + 1)  # nodes below a node are those up to its stop
        for at in range(n - 1, -1, -1):
            for child in (left[at], right[at]):
                if child >= 0:
                    self.parent[child] = at
                    self.stop[at] = max(self.stop[at], self.stop[child])

    def home(self, q: np.ndarray, k: int, size: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaves, queries): the leaves below the deepest node of at least k rows on each query's way; ``size``: rows of the leaves."""
        leaf = self.axis < 0
        total = np.concatenate([[0], np.cumsum([size.get(p, 0) if x else 0 for p, x in zip(self.path, leaf, strict=True)])])
        count, at = total[self.stop] - total[:-1], self.leaf(q)
        while len(up := np.flatnonzero((count[at] < k) & (self.parent[at] >= 0))):
            at[up] = self.parent[at[up]]
        for node in np.unique(at):
            below = np.arange(node, self.stop[node])
            yield below[leaf[below]], np.flatnonzero(at == node)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into: left where the component is at most the value."""
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if len(self.axis) > 1 else np.zeros(0, np.int64)
        while len(live):
            node = at[live]
            at[live] = np.where(x[live, self.axis[node]] > self.value[node], self.right[node], self.left[node])
            live = live[self.axis[at[live]] >= 0]
        return at

    def within(self, q: np.ndarray, tau: np.ndarray, metric: str = "euclidean") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, queries, least distances) of the leaves whose box is within ``tau`` of each query."""
        todo = [(0, np.arange(len(q)), np.zeros(len(q)), {})]
        while todo:
            node, rows, gap, off = todo.pop()
            axis = int(self.axis[node])
            if axis < 0:
                yield node, rows, np.sqrt(gap) if metric == "euclidean" else gap
                continue
            over = q[rows, axis] - self.value[node]
            was = off.get(axis, np.zeros(len(rows)))
            for child, beyond in ((int(self.left[node]), over > 0), (int(self.right[node]), over <= 0)):
                now = np.where(beyond, np.maximum(was, np.abs(over)), was)
                own = gap + (now * now - was * was if metric != "manhattan" else now - was)
                limit = tau[rows] + SLACK
                on = own <= (limit * limit if metric == "euclidean" else limit)
                if on.any():
                    todo.append((child, rows[on], own[on], {a: o[on] for a, o in off.items()} | {axis: now[on]}))


def located(rows: DataFrame, tree: dict, kept: list[str] | None = None) -> DataFrame:
    """``rows`` (id, vec, and columns ``kept``) with ``cell``, the path of their leaf ('0' left, '1' right), found in tasks."""
    held = rows.sparkSession.sparkContext.broadcast(HalfTree(tree))
    rows = rows.select("id", doubles("vec").alias("vec"), *(kept or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = held.value.path[held.value.leaf(matrix(batch.column(1)))].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.string())], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.StringType())]))


def sampled_tree(rows: DataFrame, depth: int, cut: float = 0.5, most: int = SAMPLE_ROWS) -> dict:
    """A tree that cuts a sample of up to ``most`` rows (id, vec) at this quantile of its widest side, ``depth`` times."""
    some = rows.select("id", doubles("vec").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(most).toArrow() if depth else None

    def grow(x: np.ndarray, depth: int) -> dict:
        if not depth or len(x) < 2:
            return {}
        axis = int(np.ptp(x, axis=0).argmax())
        value = float(np.quantile(x[:, axis], cut, method="lower"))
        left = x[:, axis] <= value
        return {} if left.all() else {"axis": axis, "value": value, "left": grow(x[left], depth - 1), "right": grow(x[~left], depth - 1)}

    return grow(matrix(some["vec"].combine_chunks()), depth) if depth and some.num_rows else {}


class ShellTree:
    """Nodes of shells within shells: each inner node has a vantage point, and each child the least and greatest
    distance of its rows to it."""

    def __init__(self, pivots: dict[str, np.ndarray], leaves: list[tuple[str, list[tuple[str, float, float]]]], size: dict[str, int], metric: Metric) -> None:
        self.pivots, self.metric = pivots, metric
        self.children: dict[str, dict[str, tuple[float, float]]] = {}
        self.size: dict[str, int] = {}
        for leaf, above in leaves:
            path = [p for p, _, _ in above[1:]] + [leaf]
            for (node, low, high), child in zip(above, path, strict=True):
                held = self.children.setdefault(node, {})
                a, b = held.get(child, (np.inf, -np.inf))
                held[child] = (min(a, low), max(b, high))
                self.size[child] = self.size.get(child, 0) + size[leaf]

    def home(self, q: np.ndarray, k: int) -> Iterator[tuple[str, np.ndarray]]:
        """(node, queries): the deepest node of at least k rows on each query's way through the nearest shells."""
        todo = [("", np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            held = {c: b for c, b in self.children.get(node, {}).items() if self.size[c] >= k}
            if not held:
                yield node, rows
                continue
            d = distances(q[rows], self.pivots[node][None], self.metric)[:, 0].round(9)
            low, high = (np.array([b[i] for b in held.values()]) for i in (0, 1))
            near = np.maximum(np.maximum(low - d[:, None], d[:, None] - high), 0).argmin(1)
            todo += [(c, rows[near == i]) for i, c in enumerate(held) if (near == i).any()]

    def within(self, q: np.ndarray, tau: np.ndarray, start: str = "", rows: np.ndarray | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(leaf, queries, distances to its vantage point) of the leaves below ``start`` whose shells are all within ``tau``."""
        todo = [(start, np.arange(len(q)) if rows is None else rows)]
        while todo:
            node, rows = todo.pop()
            d = distances(q[rows], self.pivots[node][None], self.metric)[:, 0].round(9)
            for child, (low, high) in self.children.get(node, {}).items():
                on = np.maximum(low - d, d - high) <= tau[rows] + SLACK
                if on.any():
                    if child in self.children:
                        todo.append((child, rows[on]))
                    else:
                        yield child, rows[on], d[on]

    def leaf_distance(self, q: np.ndarray, leaf: str) -> np.ndarray:
        return distances(q, self.pivots[leaf.rpartition("/")[0]][None], self.metric)[:, 0].round(9)
