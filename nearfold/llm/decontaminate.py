"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased (A-Z) and split at ASCII white space and punctuation.  Each of ``MASKS`` keeps
six token positions of a window of up to 12 and ignores the rest, so a window with substitutions at
ignored positions still hashes alike.  Hashes of all windows of the benchmark are joined with those
of all windows of the documents; around each hit, the item is laid along the document at that offset
and the stretch with the most equal tokens is taken among all that have at least ``IDENTITY`` equal.
A leak has at least ``min(MIN_MATCH, ceil(IDENTITY * tokens of the item))`` equal tokens there.
The four masks find every stretch of 15 tokens with up to three substitutions, and every item of 15
to 24 tokens with a fifth of them substituted; ``SHORT_MASKS`` do so for items of 8 to 14.  Items of
``MIN_ITEM`` to 7 tokens leak where they stand word for word; ``WHOLE_MASKS`` keep all their tokens.

The benchmark is the stated query set: it is read in blocks of ``BLOCK_TOKENS`` tokens, each
block's vocabulary and sorted hashes (under 200 MB) go to the workers as one broadcast, and the
documents are scanned once a block without any shuffle.  Token ids are those of the block's own
vocabulary, so a document window with any other token drops out before it is hashed, and equal
hashes are settled by comparing tokens.

Defined cases: null or empty texts and items have no windows and give no rows; an item of fewer than
``MIN_ITEM`` tokens can't be told from chance and gives none; a null doc_id or item_id is carried; repeated rows each give their rows; empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, small_batches, staged, text_bytes

#: Kept positions; together they meet every 15 tokens with three or fewer substitutions.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 2, 4, 8, 9, 10), (0, 1, 5, 7, 9, 10), (0, 1, 3, 6, 7, 11))
#: For items of fewer than ``SHORT`` tokens: five kept positions, which meet all with up to a fifth substituted.
SHORT, SHORT_MASKS = 15, ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
#: For items of fewer than ``WHOLE`` tokens: all positions.
MIN_ITEM, WHOLE = 5, 8
WHOLE_MASKS = tuple(tuple(range(n)) for n in range(MIN_ITEM, WHOLE))
MIN_MATCH = 13
IDENTITY = 0.8
BLOCK_TOKENS = 1_000_000
ROWS, HITS = 256, 1_000_000

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
TO_SPACE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
LEAK = "array<struct<item:int,matched:long,length:long,start:long>>"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


def _hashes(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows whose kept tokens are all known (not 0)."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids != 0
    at = np.flatnonzero(reduce(np.logical_and, (known[o : o + n] for o in mask)))
    h = np.zeros(len(at), np.uint64)
    for o, c in zip(mask, ODD, strict=False):
        h = (h ^ (ids[at + o].astype(np.uint64) * c)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return at, h


def _uses() -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, least, bound): masks, and the lengths of the items that they are for."""
    return [*((m, SHORT, 1 << 60) for m in MASKS), *((m, WHOLE, SHORT) for m in SHORT_MASKS), *((m, len(m), len(m) + 1) for m in WHOLE_MASKS)]


class Block:
    """A block of the benchmark: vocabulary, items as token ids, and per mask the sorted hashes."""

    def __init__(self, items: list[list[bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for words in items]
        self.items = [np.array(x, np.int32) for x in ids]
        flat = np.concatenate([np.r_[x, 0] for x in self.items] or [np.zeros(0, np.int32)]).astype(np.int32)
        owner = np.repeat(np.arange(len(ids)), [len(x) + 1 for x in ids])
        begin = np.cumsum([0, *(len(x) + 1 for x in ids)])
        self.index = []
        size = np.array([len(x) for x in ids], np.int64)
        for mask, low, high in _uses():
            at, h = _hashes(flat, mask)
            own = (owner[at] == owner[at + mask[-1]]) & (size[owner[at]] >= low) & (size[owner[at]] < high)
            at, h = at[own], h[own]
            order = np.argsort(h, kind="stable")
            at = at[order]
            self.index.append((h[order], owner[at].astype(np.int32), (at - begin[owner[at]]).astype(np.int32)))

    def leaks(self, words: list[list[bytes]]) -> list[list[tuple[int, int, int, int]]]:
        """Per document the best leak of each item: (item, matched, length, start)."""
        get = self.vocabulary.get
        counts = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(begin[-1], np.int32)
        for w, b in zip(words, begin, strict=False):
            if w:
                ids[b : b + len(w)] = [get(x, 0) for x in w]
        found = np.zeros((2, 0), np.int64)  # items and shifts, each pair once
        for (mask, _, _), (table, item, pos) in zip(_uses(), self.index, strict=True):
            if not len(table):
                continue
            at, h = _hashes(ids, mask)
            if not len(at):
                continue
            low = np.searchsorted(table, h)
            hit = table[np.minimum(low, len(table) - 1)] == h
            at, low = at[hit], low[hit]
            many = np.searchsorted(table, h[hit], side="right") - low
            # every benchmark window with this hash: rows low, low + 1, ...; about HITS of them at a time
            part = np.cumsum(many) // HITS
            for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
                n = many[lo:hi]
                row = np.repeat(low[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found = np.unique(np.concatenate([found, [item[row], np.repeat(at[lo:hi], n) - pos[row]]], 1), axis=1)
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in words]
        for item, shift in found.T.tolist():
            text = self.items[item]
            least = len(text) if len(text) < WHOLE else min(MIN_MATCH, ceil(IDENTITY * len(text)))
            # the document of the hit: the first that ends after the item's middle hit is not known
            # here, so lay the item over each document it touches
            first = int(np.searchsorted(begin, max(shift, 0), side="right") - 1)
            last = int(np.searchsorted(begin, min(shift + len(text), begin[-1]) - 1, side="right") - 1)
            for d in range(first, last + 1):
                lo, hi = max(shift, int(begin[d])), min(shift + len(text), int(begin[d + 1]) - 1)
                if hi <= lo or item in out[d] and out[d][item][1] == len(text):  # the first whole one is the best
                    continue
                matched, length, start = _stretch(ids[lo:hi] == text[lo - shift : hi - shift])
                if matched >= least and matched >= IDENTITY * length:
                    best = out[d].get(item)
                    row = (item, matched, length, lo + start - int(begin[d]))
                    if best is None or (matched, -length, -row[3]) > (best[1], -best[2], -best[3]):
                        out[d][item] = row
        return [[x[i] for i in sorted(x)] for x in out]


def _stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, length, start) of the stretch with the most matches at ``IDENTITY`` or more; the shortest, then first."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # a stretch has four fifths equal if the sum over it (1 a match, -4 a mismatch) is not negative
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    top = np.maximum.accumulate(total[at + 1][::-1])[::-1]  # the highest sum at this or a later match
    last = np.searchsorted(-top, -total[at], side="right") - 1
    matched, length = last - np.arange(len(at)) + 1, at[last] - at + 1
    best = np.lexsort((length, -matched))[0]
    return int(matched[best]), int(length[best]), int(at[best])


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(item_ids, items) of at most ``block_tokens`` tokens, or one longer item, in order of item_id."""
    ids, items, held = [], [], 0
    for row in benchmark.select("item_id", text_bytes().alias("t")).orderBy("item_id", "t").toLocalIterator():
        words = tokens(bytes(row.t))
        if len(words) < MIN_ITEM:
            continue
        if items and held + len(words) > block_tokens:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row.item_id)
        items.append(words)
        held += len(words)
    if items:
        yield ids, items


def _scan(docs: DataFrame, items: list[list[bytes]], out: str) -> DataFrame:
    """``docs`` with a column of leaks: item is the place within ``items``."""
    block = docs.sparkSession.sparkContext.broadcast(Block(items))
    body = free_name(docs.columns, "nf_body")
    names = list(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(batch.schema.get_field_index(body)), []
            for at in range(0, len(texts), ROWS):
                rows += block.value.leaks([tokens(t) for t in texts.slice(at, ROWS).to_pylist()])
            kind = pa.list_(pa.struct([("item", pa.int32()), ("matched", pa.int64()), ("length", pa.int64()), ("start", pa.int64())]))
            found = pa.array([[dict(zip(("item", "matched", "length", "start"), x, strict=True)) for x in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), found], [*names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(LEAK))])
    return small_batches(docs).withColumn(body, text_bytes()).mapInArrow(scan, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, matched, length, start): the best stretch of each item in each document."""
    spark, parts = docs.sparkSession, []
    id_type = dict(benchmark.dtypes)["item_id"]
    for ids, items in blocks(benchmark, block_tokens):
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {id_type}")
        rows = _scan(_slim(docs), items, "leaks").select("doc_id", F.inline("leaks"))
        # one row per item of the block
        parts.append(rows.join(F.broadcast(names), "item").select("doc_id", "item_id", "matched", "length", "start"))
    if not parts:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {id_type}, matched long, length long, start long")
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, (staged(p, "leaks") for p in parts))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` in which no item leaks."""
    out, columns, first = docs, docs.columns, True
    name = free_name(columns, "nf_leaks")
    for _, items in blocks(benchmark, block_tokens):
        if not first:
            out = staged(out, "clean")
        out, first = _scan(out, items, name).filter(F.size(name) == 0).select(*columns), False
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) of a leak, with its matched tokens, stretch and identity."""
    out = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("identity", F.col("matched") / F.col("length"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
#: Masks over token windows with verification of each hit; tests hold it against all alignments.
ORACLE_SQL: dict[str, str] = {}
