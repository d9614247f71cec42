"""Arrow batches of vectors as matrices, distances in slices, and the k least of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: ``euclidean``, ``manhattan``, ``sq_euclidean``, or a function of two matrices.
Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]
SLICE = 256, 1_024  # rows of both sides that are multiplied at once


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an (n, d) matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: Metric = "euclidean") -> np.ndarray:
    """Direct distances between the rows of two matrices, in slices of bounded size.

    A callable metric takes some rows of ``a`` and all of ``b`` and returns a matrix.
    """
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        if callable(metric):
            out[at : at + step] = metric(a[at : at + step], b)
            continue
        d = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.abs(d).sum(2) if metric == "manhattan" else (d * d).sum(2)
    return np.sqrt(out) if metric == "euclidean" else out


def paired(a: np.ndarray, b: np.ndarray, metric: Metric = "euclidean") -> np.ndarray:
    """Distances between the i-th rows of two matrices; a callable metric is asked row by row."""
    if callable(metric):
        return np.array([metric(x[None], y[None])[0, 0] for x, y in zip(a, b, strict=True)], np.float64)
    d = np.empty(len(a))
    step = max(1, 4_000_000 // max(1, a.shape[1]))
    for at in range(0, len(a), step):
        x = a[at : at + step] - b[at : at + step]
        d[at : at + step] = np.abs(x).sum(1) if metric == "manhattan" else (x * x).sum(1)
    return np.sqrt(d) if metric == "euclidean" else d


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared Euclidean distances by one product of matrices, and the most by which rounding may set them off."""
    x, y = (a * a).sum(1), (b * b).sum(1)
    out = (a * -2.0) @ b.T
    out += x[:, None]
    out += y
    return out, 4 * (a.shape[1] + 8) * np.finfo(float).eps * float(x.max(initial=0) + y.max(initial=0))


def rounded(a: np.ndarray, b: np.ndarray, metric: Metric = "euclidean") -> np.ndarray:
    """``distances`` to nine decimals.  Euclidean ones come from products of matrices; pairs that are so near, or so
    near between two roundings, that these don't settle the last decimal are measured directly."""
    if metric != "euclidean" or a.size < 1024:
        return distances(a, b, metric).round(9)
    out = np.empty((len(a), len(b)))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for i in range(0, len(a), SLICE[0]):
            for j in range(0, len(b), SLICE[1]):
                own, other, part = a[i : i + SLICE[0]], b[j : j + SLICE[1]], out[i : i + SLICE[0], j : j + SLICE[1]]
                d, off = squares(own, other)
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                d *= 1e9
                np.rint(d, out=part)
                np.abs(d - part, out=d)
                d += 1e18 * off / np.maximum(part, 1)
                u, v = np.nonzero(~(d < 0.499))
                part /= 1e9
                if len(u) * 4 > part.size:
                    part[:] = distances(own, other).round(9)
                elif len(u):
                    part[u, v] = paired(own[u], other[v]).round(9)
    return out


def names(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that can be sorted."""
    out = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


class Best:
    """The k least (distance, id) of each query so far; ``limit`` is the k-th distance, infinite before there are k."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.limit = k, np.full(queries, np.inf)
        self.row, self.d, self.i = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        """Distances of every query to the rows ``ids``; infinite ones are none."""
        limit = self.limit
        if d.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        row, at = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        self.put(row, d[row, at], ids[at])

    def put(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Single distances of the queries ``row``."""
        row, d, ids = np.concatenate([self.row, row]), np.concatenate([self.d, d]), ids if self.i is None else np.concatenate([self.i, ids])
        order = np.lexsort([ids, d, row])
        row, d, ids = row[order], d[order], ids[order]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first
        self.row, self.d, self.i = (x[rank < self.k] for x in (row, d, ids))
        full = rank == self.k - 1
        self.limit[row[full]] = d[full]
