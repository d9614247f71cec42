"""Periodic runs of words, by comparing a document's word ids with every shift of themselves.

A run is a stretch of consecutive words with smallest period q, at least ``MIN_EXP`` * q and ``MIN_LEN``
words long, that no neighbouring word extends.  Words become ids (the place where each first stands,
so equal ids are equal words).  For every lag p up to n / ``MIN_EXP`` the array of ids is compared with
itself shifted by p, whole, many lags in one vectorised comparison; stretches of equal places that are long enough,
found by run-length, are the stretches of period p.  A stretch of period q shows again at the
multiples of q, with the same ends (two periods of a stretch that holds both once over have their
greatest common divisor as a period), so of the same start and length the least period is kept.

A document costs n * n / 4 comparisons, so long ones are cut: a row for each document and ``LAGS`` lags
is dealt over the cluster, and the stretches found come back by a hash of (row, start, length), which
keeps the least period.  Texts of up to ``WHOLE_BYTES`` bytes are of few ranges and are scanned where they
stand, without a shuffle; that changes where the work is done and nothing else.

``collapse`` keeps each run's first q words and drops the others, whichever run they belong to.

Defined cases: a null or empty text, or one of white space, has no words, no runs and collapses to the
empty text; every row counts by itself, so repeated rows and null doc_ids are kept; an empty table
gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, small_batches, staged, text_bytes

MIN_EXP, MIN_LEN = 4, 6
LAGS = 1_024
WHOLE_BYTES = 1 << 16
ROWS = 512
SMALL = (1 << 16) - 1  # words whose ids fit in 16 bits, with one to spare
CELLS = 1 << 17  # comparisons made at once

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

# --- one document ---------------------------------------------------------------------------


def word_ids(words: list[bytes]) -> np.ndarray:
    """The place where each word first stands."""
    first: dict[bytes, int] = {}
    n = len(words)
    return np.fromiter(map(first.setdefault, words, range(n)), np.uint16 if n < SMALL else np.uint32, n)


def stretches(ids: np.ndarray, lags: range, min_exp: int = MIN_EXP, min_len: int = MIN_LEN) -> np.ndarray:
    """(start, length, period) of the maximal stretches whose period is one of these lags, the least for each stretch."""
    n, found = len(ids), [np.zeros((0, 3), np.int64)]
    if not lags:
        return found[0]
    behind = np.concatenate([ids[lags.start :], np.full(lags.stop, -1).astype(ids.dtype)])  # nothing equals what stands behind the end
    shifted = np.lib.stride_tricks.sliding_window_view(behind, n)
    step = max(1, CELLS // n)
    for at in range(0, len(lags), step):
        block = lags[at : at + step]
        equal = shifted[at : at + len(block)] == ids  # a row for each lag
        many = np.bitwise_count(np.packbits(equal, axis=1)).sum(1, dtype=np.int64)
        period = np.arange(block.start, block.stop)
        least = np.maximum(min_len - period, (min_exp - 1) * period)  # equal places that make a run of this period
        for i in np.flatnonzero(many >= least):
            if equal[i].tobytes().find(b"\1" * int(least[i])) < 0:
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], equal[i].view(np.int8), [0]])))
            start, length = edge[::2], edge[1::2] - edge[::2]
            on = length >= least[i]
            found.append(np.stack([start[on], length[on] + period[i], np.full(on.sum(), period[i])], 1))
    return least_periods(np.concatenate(found))


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) alike in start and length the least period; by start, then period."""
    runs = runs[np.lexsort([runs[:, 2], runs[:, 1], runs[:, 0]])]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort([runs[:, 2], runs[:, 0]])]


def all_lags(n: int, min_exp: int = MIN_EXP, min_len: int = MIN_LEN) -> range:
    return range(1, n // min_exp + 1) if n >= min_len else range(0)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: no run holds it after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    return b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs))])


# --- tables ---------------------------------------------------------------------------------


def find_runs(docs: DataFrame, min_exp: int = MIN_EXP, min_len: int = MIN_LEN, lags: int = LAGS, whole_bytes: int = WHOLE_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless kept) with ``runs``, by start and period, and ``collapsed``, the text without repeats.

    ``min_exp`` is two or more.
    """
    if min_exp < 2:
        raise ValueError("min_exp is two or more")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > whole_bytes
    body, rid = (free_name(docs.columns, c) for c in ("nf_body", "nf_row"))
    kept = [c for c in docs.columns if keep_text or c != "text"]

    def here(texts: list[bytes], _) -> list[np.ndarray]:
        ids = (word_ids(t.split()) for t in texts)
        return [stretches(i, all_lags(len(i), min_exp, min_len), min_exp, min_len) for i in ids]

    short = _with_runs(docs.filter(~long).withColumn(body, text_bytes()), kept, body, None, here)
    rows = staged(docs.filter(long).withColumn(body, text_bytes()).withColumn(rid, F.monotonically_increasing_id()), "long_texts")
    found = _spread(rows.select(F.col(rid).alias("row"), F.col(body).alias("t")), min_exp, min_len, lags)
    runs = free_name([*docs.columns, body, rid], "nf_runs")
    per_row = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias(runs))  # runs of one text
    per_row = per_row.select(F.col("row").alias(rid), runs)

    def given(texts: list[bytes], column: pa.Array) -> list[np.ndarray]:
        own = (np.array([(r["start"], r["length"], r["period"]) for r in x or []], np.int64).reshape(-1, 3) for x in column.to_pylist())
        return [least_periods(x) for x in own]

    return short.unionByName(_with_runs(rows.join(per_row, rid, "left"), kept, body, runs, given))


def _with_runs(rows: DataFrame, kept: list[str], body: str, runs: str | None, run) -> DataFrame:
    """``kept`` columns with runs and collapsed, for texts in ``body``; ``run`` takes texts and the column ``runs``."""
    names = [free_name(kept, "runs"), free_name(kept, "collapsed")]
    columns = [c for c in kept if c != "text"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column(len(columns)).to_pylist()
            found = run(texts, batch.column(len(columns) + 1) if runs else None)
            flat = np.concatenate(found)
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], RUN.names))
            short = pa.array([collapse(t.split(), f) for t, f in zip(texts, found, strict=True)], pa.binary())
            back = batch.columns[: len(columns) + ("text" in kept)]
            yield pa.RecordBatch.from_arrays([*back, lists, short], [*columns, *([body] if "text" in kept else []), *names])

    text = [T.StructField(body, T.BinaryType())] if "text" in kept else []
    schema = T.StructType([*(rows.schema[c] for c in columns), *text, T.StructField(names[0], T.ArrayType(RUN)), T.StructField(names[1], T.BinaryType())])
    out = small_batches(rows).select(*columns, body, *([runs] if runs else [])).mapInArrow(parts, schema)
    whole = [F.col(body).cast("string").alias("text") if c == "text" else F.col(c) for c in kept]
    return out.select(*whole, names[0], F.col(names[1]).cast("string").alias(names[1]))


def _spread(texts: DataFrame, min_exp: int, min_len: int, lags: int) -> DataFrame:
    """(row, start, length, period) of all runs of (row, t), each text by ranges of lags on many tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_ids(t.split()).astype(np.uint32)
                for first in all_lags(len(ids), min_exp, min_len)[::lags]:
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([first]), pa.array([ids.tobytes()], pa.binary())], ["row", "first", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, first, ids = (c[i].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, np.uint32)
                ids = ids.astype(np.uint16) if len(ids) < SMALL else ids
                own = all_lags(len(ids), min_exp, min_len)
                found = stretches(ids, range(first, min(first + lags, own.stop)), min_exp, min_len)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), *(pa.array(np.ascontiguousarray(found[:, c])) for c in range(3))], ["row", *RUN.names])

    ranges = small_batches(texts).mapInArrow(cut, "row long, first long, ids binary").repartition("row", "first")
    found = ranges.mapInArrow(scan, "row long, start long, length long, period long")
    return found.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


# --- query ----------------------------------------------------------------------------------


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by crc32 of its id) repeats a stretch of its words to its end."""

    def plant(h: int, text: bytes) -> bytes:
        words, g = text.split(), h // 10
        n = len(words)
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [plant(x, t) if x is not None and x % 10 == 0 else t for x, t in zip(h, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "t"])

    h = F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")
    rows = docs.select("doc_id", h, text_bytes().alias("t")).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("t", T.BinaryType())]))
    return rows.select("doc_id", F.col("t").cast("string").alias("text"))


def _greatest(runs: str) -> Column:
    """The run with the greatest length / period, exactly; the first of several."""
    higher = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(higher(a, b), b).otherwise(a))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the greatest of them, and digests of all and of the text without repeats."""
    found = find_runs(planted(documents(spark, sf_dir).select("doc_id", "text")), keep_text=False)
    out = found.withColumn("best", _greatest("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
#: All lags of all documents are too much for SQL; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
