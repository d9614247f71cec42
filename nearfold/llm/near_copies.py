"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact, by prefix keys: shingles (XXH64, seed 42) are put in one order for all texts, common ones last:
first those common in a sample, then, by exact counts, the keys that came out large all the same, so
that a passage which many texts share is no key of theirs.  Of two sets with similarity 0.8 or more, the first ``n - ceil(0.8 n) + 1`` shingles of
each share at least ``ceil(4 / 9 (n + m)) - ceil(0.8 max(n, m)) + 1``, since so many of the first in
the order that both hold stand before either prefix ends.  Sample and counts only set the order, so
they cost no pair.

* Equal sets are one node from the start.
* Golay keys come first, as in op7: sets whose SimHash fingerprints, over the same shingles, differ in at most
  ``simhash.RADIUS`` bits are candidates, and those that their texts confirm (one text of each set) are joined into components.
* Prefix keys complete the links.  Rows are dealt by key and stand by size within it, so near
  copies are neighbours.  Neighbours under that many keys that are not in one component are verified by their texts too.
* Only keys whose sets are not in one component by then need a look.  A similar pair that shares no key
  of more than ``SMALL`` sets shares that many small ones: pairs of different components are counted, and
  those with enough verified.
* A similar pair that shares a large key meets there, in tasks: the key is cut into blocks of ``RUN`` and
  every two blocks meet.

Golay keys alone can't do this at a radius that they can cover: at similarity 0.8 about ten of 64 bits differ.

Defined cases: a text without words (null, empty, white space) is the empty set, equal to any other;
fewer than five words make one shingle; null and repeated doc_ids as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import scratch, small_batches, staged, text_bytes
from .simhash import components, named

WORDS = 5
SMALL = 64
RUN, RUN_WORDS = 1024, 1_000_000
#: The order of the shingles: documents of the sample, how many must hold a shingle to make it common, the sets of a large key, and the table's size.
SAMPLE, COMMON, LARGE, MOST = 10_000, 4, 16, 500_000
BROADCAST_SETS = 500_000


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    w = text.lower().split()
    parts = map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64).view(np.int64))


def set_id(h: np.ndarray) -> int:
    """A signed 64-bit id of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64)) if len(h) else 0


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number; 0 for the empty one."""
    parts = (simhash.bit_counts(h[at : at + simhash.CHUNK]) for at in range(0, len(h), simhash.CHUNK))
    return int(simhash.majority(sum(parts, np.zeros(64, np.int64)), len(h)).view(np.int64))


def common_shingles(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, how many sampled texts hold each) of the shingles that many texts hold."""
    share = min(1.0, sample / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t))], ["h"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select(text_bytes().alias("t"))
    top = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    rows = top.orderBy(F.desc("n"), "h").limit(MOST).toPandas().sort_values("h")
    return rows["h"].to_numpy(np.int64), (rows["n"].to_numpy() / share).astype(np.int64)


def refined(distinct: DataFrame, common: tuple[np.ndarray, np.ndarray], small: int = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """``common`` with the keys of ``distinct`` (fp, keys) that more than ``small`` sets have, up to ``MOST``."""
    counts = distinct.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small)
    rows = counts.orderBy(F.desc("n"), "h").limit(MOST).toPandas()
    h, n = np.r_[common[0], rows["h"].to_numpy(np.int64)], np.r_[common[1], rows["n"].to_numpy(np.int64)]
    by = np.lexsort([n, h])
    last = np.flatnonzero(np.r_[h[by][1:] != h[by][:-1], True]) if len(h) else by
    return h[by][last], n[by][last]


def prefix(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles in the order, enough that similar sets share one."""
    held, count = common
    often = np.zeros(len(h), np.int64)
    if len(held):
        at = np.minimum(np.searchsorted(held, h), len(held) - 1)
        often = np.where(held[at] == h, count[at], 0)
    return h[np.lexsort((h, often))][: len(h) - (4 * len(h) + 4) // 5 + 1] if len(h) else h


def prints(docs: DataFrame, common: tuple[np.ndarray, np.ndarray] | None = None, sims: bool = False) -> DataFrame:
    """(doc_id, fp, n, keys, sim): the id and size of each text's set, its prefix if ``common`` is given, and its fingerprint if asked for."""
    held = None if common is None else docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, out, sim = [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t)
                fp.append(set_id(h))
                n.append(len(h))
                out.append(prefix(h, held.value) if held is not None else None)
                sim.append(fingerprint(h) if sims else None)
            cells = [pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int64())), pa.array(sim, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", "fp", "n", "keys", "sim"])

    kinds = {"fp": T.LongType(), "n": T.IntegerType(), "keys": T.ArrayType(T.LongType()), "sim": T.LongType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in kinds.items())])
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, schema)


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(fp, t): one text of each set id in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(shingles(t)) for t in part.to_pylist()], pa.int64()), part], ["fp", "t"])

    asked = staged(asked.distinct(), "asked")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_SETS else asked
    found = docs.select(text_bytes().alias("t")).mapInArrow(run, "fp long, t binary")
    return staged(found.join(few, "fp", "left_semi").dropDuplicates(["fp"]), "texts")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.int64)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, own = a, shingles(batch.column(2)[i].as_py())
                other = shingles(batch.column(3)[i].as_py())
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(9 * both >= 4 * (len(own) + len(other)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts(docs, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))
    x, y = (texts.select(F.col("fp").alias(c), F.col("t").alias(f"t{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb")
    return staged(both.mapInArrow(run, "a long, b long"), "similar")


def _may(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


GROUPED = "a long, b long, n int, need int"


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray | None, need: np.ndarray | None) -> pa.RecordBatch:
    own = [pa.nulls(len(a), pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (n, need)]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *own], ["a", "b", "n", "need"])


def _pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, b, null, need) of set ids of n and m shingles: similar sets share at least ``need`` keys."""
    need = -(-4 * (n + m) // 9) - (4 * np.maximum(n, m) + 4) // 5 + 1
    return _rows(np.minimum(x, y), np.maximum(x, y), None, np.maximum(need, 1))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, fp, n) sorted by all three: neighbours of a key as pairs, and the rows (key, fp, n, null)
    of every key with more than one.  Only the last row is carried on, so a key may have any number."""
    key, fp, n, again = *(np.zeros(0, np.int64) for _ in range(3)), False
    for batch in batches:
        key, fp, n = (np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate((key, fp, n)))
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        at = np.flatnonzero(same)
        at = at[_may(n[at], n[at + 1])]
        yield _pairs(fp[at], fp[at + 1], n[at], n[at + 1])
        before = np.r_[again, same]
        k = np.flatnonzero(before[:-1] | same)
        yield _rows(key[k], fp[k], n[k], None)
        key, fp, n, again = key[-1:], fp[-1:], n[-1:], bool(before[-1])
    if again:
        yield _rows(key, fp, n, None)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, fp, n, root) sorted by key, few a key: pairs of different roots."""
    held = [np.zeros(0, np.int64) for _ in range(4)]

    def done(upto: int) -> Iterator[pa.RecordBatch]:
        key, fp, n, root = (x[:upto] for x in held)
        at, lag = np.arange(upto), 1
        while len(at):
            at = at[at + lag < upto]
            at = at[key[at + lag] == key[at]]
            hit = at[(root[at] != root[at + lag]) & _may(n[at], n[at + lag])]
            yield _pairs(fp[hit], fp[hit + lag], n[hit], n[hit + lag])
            lag += 1

    for batch in batches:
        held = [np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate(held)]
        if len(held[0]) >= 200_000:
            upto = int(np.searchsorted(held[0], held[0][-1]))
            yield from done(upto)
            held = [x[upto:] for x in held]
    yield from done(len(held[0]))


def _tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between sets of different components in one tile (two blocks of a key, or one)."""
    one = key[1] == key[2]
    fp, n, block, root = (pdf[c].to_numpy(np.int64) for c in ("fp", "n", "block", "root"))
    root = np.unique(root, return_inverse=True)[1]
    sets = [shingles(t) for t in pdf["t"]]
    size = np.array([len(x) for x in sets], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark, out_a, out_b = np.zeros(len(names), bool), [], []
    for i in range(len(fp) - 1):
        rest = slice(i + 1, None)
        to = i + 1 + np.flatnonzero((root[rest] != root[i]) & _may(n[i], n[rest]) & (one | (block[rest] != block[i])))
        if not len(to):
            continue
        own = flat[begin[i] : begin[i] + size[i]]
        mark[own] = True
        if len(to) * 4 < len(fp):
            both = np.array([np.count_nonzero(mark[flat[begin[j] : begin[j] + size[j]]]) for j in to])
        else:
            both = np.add.reduceat(mark[flat], begin, dtype=np.int64)[to]
        mark[own] = False
        for j in to[9 * both >= 4 * (size[i] + size[to])]:
            if root[j] != root[i]:
                out_a.append(min(fp[i], fp[j]))
                out_b.append(max(fp[i], fp[j]))
                root[root == root[j]] = root[i]
    return pd.DataFrame({"a": pd.Series(out_a, dtype="int64"), "b": pd.Series(out_b, dtype="int64")})


def _enough(grouped: DataFrame) -> DataFrame:
    """Pairs (a, b) found under as many keys as similar sets share."""
    of = grouped.filter("n IS NULL").groupBy("a", "b").agg((F.count(F.lit(1)) >= F.min("need")).alias("enough"))
    return staged(of.filter("enough").select("a", "b"), "pairs")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (sim, n, fp) sorted by all three: neighbours of one fingerprint, where they can be similar."""
    sim, n, fp = (np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        sim, n, fp = (np.concatenate([x[-1:], batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate((sim, n, fp)))
        at = np.flatnonzero((sim[1:] == sim[:-1]) & _may(n[:-1], n[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[at], fp[at + 1])), pa.array(np.maximum(fp[at], fp[at + 1]))], ["a", "b"])


def golay_pairs(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) by op7's Golay keys over (fp, n, sim): fingerprints at most ``simhash.RADIUS`` bits apart, by one set
    of each, and sets of the same fingerprint, one after the other (a fingerprint of many sets is cut into ranges)."""
    sims = staged(distinct.select("sim", "n", "fp"), "sims")
    same = sims.repartitionByRange("sim", "n", "fp").sortWithinPartitions("sim", "n", "fp").mapInArrow(_chain, "a long, b long")
    one = staged(sims.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("s")).select("sim", "s.fp", "s.n"), "one_of_each")
    x, y = (one.select(F.col("sim").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    close = simhash.links(one.select(F.col("sim").alias("fp"))).join(x, "a").join(y, "b")
    close = close.filter(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    return same.union(close.select(F.least("fp_a", "fp_b"), F.greatest("fp_a", "fp_b")))


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are not in one component; ``of``: (node, root)."""
    x, y = (of.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def links(docs: DataFrame, distinct: DataFrame, small: int = SMALL, run: int = RUN) -> DataFrame:
    """Edges (a, b) between set ids that connect all similar sets; ``distinct`` has (fp, n, keys, sim)."""
    first = _verified(docs, golay_pairs(distinct))
    keyed = distinct.select(F.explode("keys").alias("key"), "fp", "n")
    grouped = staged(keyed.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(_neighbours, GROUPED), "groups")
    edges = first.union(_verified(docs, _apart(_enough(grouped), components(first))))
    # what is left: keys whose sets are not in one component by now
    of = components(edges).withColumnRenamed("node", "fp")
    members = grouped.filter("n IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("fp"), "n")
    members = staged(members.join(of, "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "members")
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    live = staged(members.join(mixed.filter("low != high").select("key", "size", "words"), "key"), "live")
    few = live.filter(F.col("size") <= small).select("key", "fp", "n", "root")
    apart = _enough(few.repartition("key").sortWithinPartitions("key").mapInArrow(_across, GROUPED))
    edges = edges.union(_verified(docs, apart))
    many = live.filter(F.col("size") > small)
    if many.isEmpty():
        return edges
    # blocks of about ``run`` sets, or ``RUN_WORDS`` shingles, by the hash of the set; every two blocks of a key meet
    blocks = F.greatest(F.ceil(F.col("size") / run), F.ceil(F.col("words") / RUN_WORDS)).cast("int")
    many = many.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp", "n", "block", "root")
    found = many.join(_texts(docs, many.select("fp")), "fp").groupBy("key", "x", "y").applyInPandas(_tile, "a long, b long")
    return edges.union(staged(found.distinct(), "tile_edges"))


def near_copies(docs: DataFrame, small: int = SMALL, run: int = RUN) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    docs = small_batches(docs).select("doc_id", "text")
    common = common_shingles(docs)
    first = staged(prints(docs, common).groupBy("fp").agg(F.first("keys").alias("keys")), "first_keys")
    rows = staged(prints(docs, refined(first, common, min(small, LARGE)), sims=True), "prints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "keys", "sim")])
    return named(rows.select("doc_id", "fp"), distinct.select("fp", "least"), components(links(docs, distinct, small, run)))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id.

    Rows without a doc_id stay only where the whole component has none, one for each set of shingles;
    of rows that repeat a doc_id one stays.
    """
    with scratch(docs.sparkSession):
        found = staged(near_copies(docs), "near", keep=True)
    chosen = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    single, many = (chosen.filter(x).select("doc_id") for x in ("n = 1", "n > 1"))
    out = docs.join(single, "doc_id", "left_semi").union(docs.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
    bare = docs.filter(F.col("doc_id").isNull())
    if bare.isEmpty():
        return out
    rows = prints(bare.select(F.struct(*bare.columns).alias("doc_id"), "text"))
    alone = found.filter(F.col("component_id").isNull()).select("fp").distinct()
    return out.union(rows.join(alone, "fp").groupBy("fp").agg(F.min("doc_id").alias("r")).select("r.*"))
