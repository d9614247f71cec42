"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a short vector of shape features (lengths, character classes, repetition).
The model is a sum of lookup tables, one per feature and one per chosen pair of features, over
quantile bins.  Training cycles over the features; each step fits a shallow tree to the gradient of
the log-loss on the bins of one feature and adds it, damped, to that feature's table.  Then pairs
with the largest gain on what is left get tables of their own in the same way.  Scoring adds table
entries by bin, vectorised over a batch of documents.

Only tables are fitted on a sample: up to ``MAX_TRAIN`` labelled rows, those with the least hash of
doc_id, so the fit is the same in every run and of bounded size.  All documents are scored.

Defined cases: a null or empty text has the features of no text and is scored like any other;
rows of ``labels`` with a null or other value than 0 and 1 are left out, and where a doc_id has
several, the largest counts; without both labels the score is the share of 1 with one added to each
side; repeated rows and null doc_ids are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold, free_name, small_batches

MAX_TRAIN = 20_000
BINS, PAIR_BINS = 32, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, RIDGE = 0.12, 2.0
ROWS = 512

FEATURES = (
    "log_words", "word_length", "word_length_sd", "upper", "digit", "symbol", "punctuation", "exclaim", "pipe",
    "distinct_words", "top_word", "distinct_pairs", "line_length", "repeated_lines", "sentence_ends", "beyond_ascii",
)
_CLASS = {
    name: np.array([chr(c) in chars for c in range(128)] + [False] * 128)
    for name, chars in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letter": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "symbol": "#$%&*@^~<>{}[]\\_=+/", "punct": ".,;:!?'\"()-", "end": ".!?"}.items()
}


def features(text: bytes) -> list[float]:
    """The feature vector of a whole text."""
    words, lines = text.split(), text.split(b"\n")
    n, chars = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    lengths = np.fromiter(map(len, words), np.float64, n)
    held = Counter(words)
    of = lambda name: float(chars[_CLASS[name]].sum())
    return [
        float(np.log1p(n)),
        float(lengths.mean()) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        of("upper") / max(1.0, of("letter")),
        of("digit") / size,
        of("symbol") / size,
        of("punct") / size,
        float(chars[33]) / max(1, n),
        float(chars[124]) / max(1, n),
        len(held) / max(1, n),
        max(held.values(), default=0) / max(1, n),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        float(np.log1p(len(text) / len(lines))),
        1.0 - len(set(lines)) / len(lines),
        of("end") / max(1, n),
        float(chars[128:].sum()) / size,
    ]


class AdditiveModel:
    """Lookup tables over bins; ``score`` is a probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        ones = float(y.sum())
        self.base = float(np.log((ones + 1) / (len(y) - ones + 1)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if 0 < ones < len(y):
            self._fit(x, y.astype(float))

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def _coarse(self, b: np.ndarray, j: int) -> np.ndarray:
        return b * PAIR_BINS // (len(self.edges[j]) + 1)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = self._bins(x)
        f = np.full(len(y), self.base)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                g, h = gradient()
                size = len(self.tables[j])
                step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size), depth=2)
                self.tables[j] += step
                f += step[b]
        coarse = [self._coarse(b, j) for j, b in enumerate(bins)]
        g, h = gradient()
        shape = (PAIR_BINS, PAIR_BINS)
        gains = []
        for i in range(len(bins)):
            for j in range(i):
                at = coarse[i] * PAIR_BINS + coarse[j]
                gain, _ = _cross(np.bincount(at, g, PAIR_BINS**2).reshape(shape), np.bincount(at, h, PAIR_BINS**2).reshape(shape))
                gains.append((-gain, i, j))
        chosen = [(i, j) for _, i, j in sorted(gains)[:PAIRS]]
        grids = {c: np.zeros(shape) for c in chosen}
        for _ in range(PAIR_ROUNDS):
            for i, j in chosen:
                at = coarse[i] * PAIR_BINS + coarse[j]
                g, h = gradient()
                _, step = _cross(np.bincount(at, g, PAIR_BINS**2).reshape(shape), np.bincount(at, h, PAIR_BINS**2).reshape(shape))
                grids[i, j] += RATE * step
                f += RATE * step.ravel()[at]
        self.pairs = [(i, j, grids[i, j]) for i, j in chosen]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        f = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            f += table[b]
        for i, j, grid in self.pairs:
            f += grid[self._coarse(bins[i], i), self._coarse(bins[j], j)]
        return 1 / (1 + np.exp(-f))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a tree of this depth on histogram sums of gradient and curvature."""
    if depth and len(g) > 1:
        lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = lg**2 / (lh + RIDGE) + (g.sum() - lg) ** 2 / (h.sum() - lh + RIDGE)
        cut = int(np.argmax(gain)) + 1
        return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best pair of cuts, one on each axis: its gain, and the values of the four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    top_g, top_h, left_g, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a_g, a_h), (top_g - a_g, top_h - a_h), (left_g - a_g, left_h - a_h), (cg[-1, -1] - top_g - left_g + a_g, ch[-1, -1] - top_h - left_h + a_h)]
    gain = sum(x**2 / (y + RIDGE) for x, y in parts)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [x[r, c] / (y[r, c] + RIDGE) for x, y in parts]
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = values
    return float(gain[r, c]), out


def labelled(labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, y) of up to ``most`` labelled rows that may be learnt from, least hash first."""
    rows = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)


def with_texts(docs: DataFrame, columns: list[str], added: list[T.StructField], run) -> DataFrame:
    """``columns`` of ``docs`` with ``added``, made from the texts as bytes by ``run``.

    Texts go to Python once, as bytes, and are looked at ``ROWS`` at a time, so that a task holds few of
    them.  ``run`` takes a list of texts and returns the arrays of the added columns.
    """
    body = free_name([*docs.columns, *(f.name for f in added)], "nf_body")
    kept = [c for c in columns if c != "text"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                arrays = run([t or b"" for t in part.column(len(kept)).to_pylist()])
                back = part.columns if "text" in columns else part.columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*back, *arrays], [*kept, *([body] if "text" in columns else []), *(f.name for f in added)])

    text = [T.StructField(body, T.BinaryType())] if "text" in columns else []
    schema = T.StructType([*(docs.schema[c] for c in kept), *text, *added])
    out = small_batches(docs).select(*kept, F.col("text").cast("binary").alias(body)).mapInArrow(parts, schema)
    return out.select(*[F.col(body).cast("string").alias("text") if c == "text" else F.col(c) for c in columns], *(f.name for f in added))


def fit(docs: DataFrame, labels: DataFrame, column: str, learn: Column, most: int = MAX_TRAIN) -> AdditiveModel:
    """The model of ``labels.column`` from documents that may be learnt from."""
    rows = examples(docs, labels, column, learn, most)
    found = with_texts(rows, ["y"], [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, found["y"]]) if len(x) else np.zeros(0, int)
    return AdditiveModel(x[order], found["y"].to_numpy(np.int64)[order])


def examples(docs: DataFrame, labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of up to ``most`` labelled documents; of rows that repeat a doc_id the least text."""
    ids = labelled(labels, column, learn, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `most` rows of an id and a label
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def score(docs: DataFrame, model: AdditiveModel, keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless kept) with a column ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if keep_text or c != "text"]
    out = T.StructField(free_name(docs.columns, "score"), T.DoubleType())
    return with_texts(docs, columns, [out], lambda texts: [pa.array(held.value.score(np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))))])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~fold(3, 1))
    out = score(docs, model, keep_text=False)
    return out.select("doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
#: A fitted model; tests hold its accuracy on documents it did not learn from.
ORACLE_SQL: dict[str, str] = {}
