"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64 bits, a bit set where more than half of the shingle hashes (XXH64, seed 42) set it.
Distinct fingerprints link at ``RADIUS`` = 3 or fewer differing bits.  Candidates come from an
equi-join on keys.  The 64 bits fall into segments A (23), B (23) and C (18, padded with zeros).
In the perfect Golay code [23, 12, 7] two words at most one bit apart share a codeword within
distance 4 of both; a word has one codeword within 3 and, if that is 3 away, five more at 4.  So a
segment is decoded to one or six 12-bit codeword indices.  By pigeonhole, three errors leave either

* one segment without error and another with at most one: key = exact bits of the one, a codeword
  index of the other (six ordered pairs); or
* one error in each: key = a codeword index of A, the error-free half of B and that of C.

That makes about 55 keys of 32 to 35 bits a fingerprint.  Rows are dealt by key and sorted; each
task compares the fingerprints of a key and sends on a spanning forest of the links it confirmed.
A key with more than ``RUN`` fingerprints is not compared in place: its rows are cut into blocks of
``RUN`` and every two blocks meet in a task of their own, so no task takes an unbounded group and no
link is lost.  Exact copies are one fingerprint from the start.  Components come from alternating
large-star and small-star steps over tables in the shared folder.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like
any other; fewer words than a shingle make one shingle; rows that repeat a doc_id are kept each; a
null doc_id belongs to the component of its fingerprint and never names it (null where no row of
the component has an id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_bytes

RADIUS = 3
WORDS = 3
RUN = 2048
CHUNK = 65_536

# --- fingerprints ---------------------------------------------------------------------------


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> np.uint64:
    """The bits that more than half of ``n`` hashes set."""
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text, as an unsigned number."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = w[at : at + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        total += bit_counts(h)
    return int(majority(total, n))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


# --- Golay code -----------------------------------------------------------------------------

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


class Golay:
    """Decoding tables of the binary Golay code; built once in a process."""

    _made: Golay | None = None

    @classmethod
    def get(cls) -> Golay:
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def __init__(self) -> None:
        high = np.arange(4096, dtype=np.int64) << 11
        rem = high.copy()
        for bit in range(22, 10, -1):
            on = (rem >> bit) & 1 == 1
            rem[on] ^= GENERATOR << (bit - 11)
        self.rem = rem  # remainder of the upper 12 bits
        codewords = high | rem
        ones = 1 << np.arange(23, dtype=np.int64)
        i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(24)] * 3, indexing="ij"))
        one = np.concatenate([ones, [0]])
        keep = (i <= j) & (j <= k) & ((i < j) | (j == 23)) & ((j < k) | (k == 23))
        errors = np.unique(one[i[keep]] | one[j[keep]] | one[k[keep]])
        errors = errors[np.bitwise_count(errors) <= 3]
        self.leader = np.zeros(2048, np.int64)
        self.leader[self.syndrome(errors)] = errors
        sevens = codewords[np.bitwise_count(codewords) == 7]
        self.more = np.zeros((2048, 5), np.int64)  # index of the codewords of weight 7 over each leader of weight 3
        self.has_more = np.bitwise_count(self.leader) == 3
        for s in np.flatnonzero(self.has_more):
            lead = self.leader[s]
            self.more[s] = sevens[sevens & lead == lead] >> 11

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.rem[v >> 11] ^ (v & 2047)

    def indices(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) pairs: every codeword within distance 4 of each 23-bit word."""
        s = self.syndrome(v)
        near = (v ^ self.leader[s]) >> 11
        more = np.flatnonzero(self.has_more[s])
        rows = np.concatenate([np.arange(len(v)), np.repeat(more, 5)])
        return rows, np.concatenate([near, (near[more, None] ^ self.more[s[more]]).ravel()])


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of fingerprints (uint64); keys hold their kind in the upper bits."""
    code = Golay.get()
    seg = [(fp & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(46)).astype(np.int64)]
    decoded = [code.indices(s) for s in seg]
    rows, out = [], []
    for a in range(3):
        for b in range(3):
            if a != b:
                r, index = decoded[b]
                rows.append(r)
                out.append((np.int64(a * 3 + b + 1) << 40) | (seg[a][r] << 12) | index)
    r, index = decoded[0]
    halves_b, halves_c = (seg[1] & 2047, seg[1] >> 11), (seg[2] & 511, seg[2] >> 9)
    for x, hb in enumerate(halves_b):
        for y, hc in enumerate(halves_c):
            rows.append(r)
            out.append((np.int64(16 + 2 * x + y) << 40) | (hb[r] << 21) | (hc[r] << 12) | index)
    return np.concatenate(rows), np.concatenate(out)


# --- links ----------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out_a, out_b = [], []
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        u, v = top(x), top(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def _compare(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among equal keys; rows are sorted by key."""
    at, lag, found_a, found_b = np.arange(len(key)), 1, [], []
    u = fp.view(np.uint64)
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at + lag] == key[at]]
        hit = at[(np.bitwise_count(u[at] ^ u[at + lag]) <= RADIUS) & (u[at] != u[at + lag])]
        found_a.append(fp[hit])
        found_b.append(fp[hit + lag])
        lag += 1
    a, b = np.concatenate(found_a or [fp[:0]]), np.concatenate(found_b or [fp[:0]])
    return np.minimum(a, b), np.maximum(a, b)


LINK = "a long, b long, block int"


def _linker(run: int):
    """Over rows sorted by key: links (a, b), or rows of large keys as (key, fp, block).

    Of a key that goes on, blocks are passed on while it is read, so a key may have any number of rows.
    """

    def rows(a: np.ndarray, b: np.ndarray, block: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int32()) if block is None else pa.array(block.astype(np.int32))], ["a", "b", "block"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, gone = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # blocks that the first key held has given

        def done(k: np.ndarray, f: np.ndarray, gone: int) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(k)])
            long = sizes > run
            if len(sizes) and gone:
                long[0] = True
            large = np.repeat(long, sizes)
            if large.any():
                block = (np.arange(len(k)) - np.repeat(starts, sizes)) // run
                block[: sizes[0]] += gone
                yield rows(k[large], f[large], block[large])
            yield rows(*_forest(*_compare(k[~large], f[~large])), None)

        for batch in batches:
            key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            if len(key) < 65_536:
                continue
            upto = int(np.searchsorted(key, key[-1]))
            if upto:
                yield from done(key[:upto], fp[:upto], gone)
                key, fp, gone = key[upto:], fp[upto:], 0
            whole = (len(key) - 1) // run * run  # at least one row stays, for the key may end here
            if whole:
                yield rows(key[:whole], fp[:whole], gone + np.arange(whole) // run)
                key, fp, gone = key[whole:], fp[whole:], gone + whole // run
        yield from done(key, fp, gone)

    return link


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    fp = np.unique(pdf["fp"].to_numpy())
    a, b = _forest(*_compare(np.zeros(len(fp), np.int64), fp))
    return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def links(distinct: DataFrame, run: int = RUN) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within the radius."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                rows, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    out = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(run), LINK), "links")
    direct = out.filter(F.col("block").isNull()).select("a", "b")
    large = out.filter(F.col("block").isNotNull())
    large = large.join(large.groupBy("a").agg((F.max("block") + 1).alias("blocks")), "a")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = large.select(F.col("a").alias("key"), F.col("b").alias("fp"), "block", other)
    tiles = tiles.select("key", "fp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return direct.unionByName(tiles.groupBy("key", "x", "y").applyInPandas(_tile_of, "a long, b long")).distinct()


def _tile_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
    return _tile(pdf)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node of its component.

    Alternating large-star and small-star steps; each round is a table in the shared folder.
    """
    edges = staged(edges.select("a", "b").filter(F.col("a") != F.col("b")), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a != b").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, run: int = RUN) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return named(prints, distinct, components(links(distinct, run)))


def named(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of ``prints`` (doc_id, fp), from (fp, least) and (node, root)."""
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(rooted.join(named, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
#: XXH64 is not in the SQL engine; tests hold the query against all pairs of a small table.
ORACLE_SQL: dict[str, str] = {}
