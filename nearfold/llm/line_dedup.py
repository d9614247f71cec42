"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

State is two tables in a folder: ``refcounts`` (kind, h1, h2, n), the exact number of documents that
hold each line key, named by its 128-bit hash, and of those that have each whole text; and ``filters``
(shard, keys, table), one cuckoo filter per shard over the lines that reached ``min_docs``.  ``insert`` and
``delete`` add or subtract the counts of a batch of documents, and put into or take out of the filters
just the keys that crossed the limit, so inserting and deleting the same documents restores the state.
Both tables lie in folders of one shard each, and a change writes only the shards that its documents'
lines touch, then a manifest that names the folders (``sources.versioned``): of two sessions that change
one state at once the slower begins again from the other's version, and folders of versions before the
last two are taken away.  A ``delete`` of documents whose text was not inserted as often raises an error and changes
nothing.  When shards hold more than ``keys_per_shard`` frequent lines or ``rows_per_shard`` counts on
average, their number is doubled as often as it takes and everything is dealt anew.

Counting emits each key once per document and sums within the batch before the shuffle, so a line
that stands in every document costs one row per batch.  ``apply`` tests all lines against the
filters in numpy and settles the positives with the exact table.  Up to ``BROADCAST_KEYS`` keys
both go to the workers as one broadcast (16 bytes a key and under 4 a filter slot: 20 MB at most);
beyond that, keys of the documents go to their filter's shard, in parts, and what it lets through is
joined with the exact table; rows get ids of their own, so doc_id may be anything.

Defined cases: a null or empty text is one empty line; empty keys (fewer than ``min_chars`` code
points) are never dropped; every row counts as a document, so repeated rows count each; a doc_id
may be null or repeated; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versioned import RETRIES, Conflict, Manifest
from .common import WHITE, documents, free_name, new_path, scratch, small_batches, staged, text_bytes

MIN_DOCS = 10
MIN_CHARS = 1
BROADCAST_KEYS = 1_000_000
KEYS_PER_SHARD = 500_000
ROWS_PER_SHARD = 4_000_000
PART_KEYS = 1_000_000
SPREAD = 8  # files of a shard, so that few shards keep many tasks at work
SLOTS = 4
LINE, TEXT = 0, 1
COUNTS = T.StructType([T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("h1", "h2", "n"))])
FILTERS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("keys", T.LongType()), T.StructField("table", T.BinaryType())])


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: A-Z lower-cased, ASCII white space stripped at both ends."""
    return [line.strip(WHITE) for line in text.lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)


# --- cuckoo filter -------------------------------------------------------------------------


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key is a 64-bit hash."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table.reshape(buckets, SLOTS).copy()
        self.mask = buckets - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, -(-keys * 5 // (SLOTS * 4)))
        return cls(1 << (need - 1).bit_length())

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        a = (h & np.uint64(self.mask)).astype(np.int64)
        return fp, a, a ^ self._step(fp)

    def _step(self, fp: np.ndarray) -> np.ndarray:
        return ((fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(h)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, h: np.ndarray, kicks: int = 500) -> bool:
        """False if a key finds no place; the filter is then to be made anew, larger."""
        table, rng = self.table, np.random.default_rng(7)
        for fp, a, b in zip(*self._places(h), strict=True):
            for at in (a, b):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = fp
                    break
            else:
                at = a if rng.random() < 0.5 else b
                for _ in range(kicks):
                    slot = rng.integers(SLOTS)
                    fp, table[at, slot] = table[at, slot], fp
                    at ^= int(self._step(np.array([fp], np.uint16))[0])
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Takes out keys that are known to be in."""
        for fp, a, b in zip(*self._places(h), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


# --- state ---------------------------------------------------------------------------------


class LineDedup:
    """Incremental line dedup over a state folder that driver and executors share.

    Every change writes what it touches beside the last version; a reader of the last one is not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS, keys_per_shard: int = KEYS_PER_SHARD, rows_per_shard: int = ROWS_PER_SHARD) -> None:
        """A new folder takes the limits given here, one in use keeps its own ``min_docs`` and ``min_chars``."""
        self.spark, self.manifest = spark, Manifest(spark, path or new_path(spark, "lines"))
        self.min_docs, self.min_chars = min_docs, min_chars
        self.broadcast_keys, self.keys_per_shard, self.rows_per_shard = broadcast_keys, keys_per_shard, rows_per_shard
        self._take(*self.manifest.last())

    @property
    def path(self) -> str:
        return self.manifest.path

    def _take(self, version: int, content: dict) -> None:
        """This version is the one at hand."""
        self.version, self.content = version, content
        self.shards, self.frequent = content.get("shards", 1), content.get("frequent", 0)
        self.min_docs, self.min_chars = content.get("min_docs", self.min_docs), content.get("min_chars", self.min_chars)

    def _counts(self, docs: DataFrame) -> DataFrame:
        """(kind, h1, h2, n): documents that hold each line, and that have each text."""
        least = self.min_chars

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines: Counter[bytes] = Counter()
                texts: Counter[bytes] = Counter()
                for text in batch.column(0).to_pylist():
                    texts[xxhash.xxh3_128_digest(text)] += 1
                    lines.update({xxhash.xxh3_128_digest(k) for k in set(line_keys(text)) if _long_enough(k, least)})
                h = np.frombuffer(b"".join(chain(lines, texts)), "<i8").reshape(-1, 2)
                n = np.fromiter(chain(lines.values(), texts.values()), np.int64, len(h))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([LINE, TEXT], [len(lines), len(texts)]).astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n)], COUNTS.names)

        rows = small_batches(docs).select(text_bytes().alias("t")).mapInArrow(count, COUNTS)
        return rows.groupBy("kind", "h1", "h2").agg(F.sum("n").alias("n"))

    def _read(self, table: str, shards: list[str] | None = None) -> DataFrame:
        folders = self.content.get(table, {})
        return self.manifest.read([f for s, f in folders.items() if shards is None or s in shards], COUNTS if table == "counts" else FILTERS)

    def refcounts(self) -> DataFrame:
        """(h1, h2, n) of the lines."""
        return self._read("counts").filter(F.col("kind") == LINE).select("h1", "h2", "n")

    def filters(self) -> DataFrame:
        """(shard, keys, table)."""
        return self._read("filters")

    def insert(self, docs: DataFrame) -> LineDedup:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineDedup:
        """Documents that were inserted before."""
        return self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> LineDedup:
        with scratch(self.spark):
            return self._commit(docs, sign)

    def _commit(self, docs: DataFrame, sign: int) -> LineDedup:
        delta = staged(self._counts(docs).select("kind", "h1", "h2", (F.col("n") * sign).alias("n")), "delta")
        for _ in range(RETRIES):
            self._take(*self.manifest.last())
            content = self._changed(delta)
            try:
                self.manifest.commit(self.version + 1, content)
            except Conflict:
                continue
            self._take(self.version + 1, content)
            self.manifest.vacuum(2, lambda c: [*c["counts"].values(), *c["filters"].values()])
            return self
        raise Conflict(f"{RETRIES} other sessions were faster")

    def _changed(self, delta: DataFrame) -> dict:
        """The content of the version after this one."""
        of = lambda n: F.pmod("h1", F.lit(n)).cast("int")
        touched = [str(r[0]) for r in delta.select(of(self.shards)).distinct().collect()]  # a row per shard at most
        changed = self._merged(delta, touched)
        if changed.filter("n < 0").limit(1).count():
            raise ValueError("documents that were not inserted can't be deleted")
        now, was, line = F.col("n") >= self.min_docs, F.col("was") >= self.min_docs, F.col("kind") == LINE
        more = changed.agg(F.sum(F.when(line, now.cast("int") - was.cast("int"))), F.sum((F.col("n") > 0).cast("int") - (F.col("was") > 0).cast("int"))).first()
        frequent, rows = self.frequent + (more[0] or 0), self.content.get("rows", 0) + (more[1] or 0)
        shards = self.shards
        while frequent > shards * self.keys_per_shard or rows > shards * self.rows_per_shard:
            shards *= 2
        counts, filters = self.content.get("counts", {}), self.content.get("filters", {})
        if shards != self.shards:  # all shards anew
            changed = self._merged(delta, list(counts) + touched)
            touched, counts, filters = [str(s) for s in range(shards)], {}, {}
        kept = lambda folders: {s: f for s, f in folders.items() if s not in touched}
        written = self.manifest.write(changed.filter("n > 0").select(*COUNTS.names, of(shards).alias("nf_shard")), "nf_shard", F.pmod("h2", F.lit(SPREAD)))
        step = F.lit(1) if shards != self.shards else now.cast("int") - was.cast("int")
        keys = changed.filter(line & (now if shards != self.shards else now | was)).select(of(shards).alias("shard"), "h2", step.alias("step"))
        old = self._read("filters", touched if filters else [])
        made = old.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(_update_filter, FILTERS)
        made = self.manifest.write(made.withColumn("nf_shard", F.col("shard")), "nf_shard")
        return {
            "shards": shards, "frequent": frequent, "rows": rows, "min_docs": self.min_docs, "min_chars": self.min_chars,
            "counts": kept(counts) | written, "filters": kept(filters) | made,
        }

    def _merged(self, delta: DataFrame, shards: list[str]) -> DataFrame:
        """(kind, h1, h2, was, n) of these shards."""
        zero = F.lit(0).cast("long")
        if not self.content:
            return delta.select("kind", "h1", "h2", zero.alias("was"), "n")
        both = self._read("counts", shards).withColumn("was", F.col("n")).unionByName(delta.withColumn("was", zero))
        return staged(both.groupBy("kind", "h1", "h2").agg(F.sum("was").alias("was"), F.sum("n").alias("n")), "changed")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the frequent lines gone from ``text``, and n_lines, n_dropped (long) added."""
        return self._apply_broadcast(docs) if self.frequent <= self.broadcast_keys else self._apply_shuffled(docs)

    def _out(self, docs: DataFrame) -> tuple[str, str, str, str]:
        return tuple(free_name(docs.columns, c) for c in ("n_lines", "n_dropped", "nf_text", "nf_drop"))

    def _apply_broadcast(self, docs: DataFrame) -> DataFrame:
        spark, shards = self.spark, self.shards
        exact = self.refcounts().filter(F.col("n") >= self.min_docs).select("h1", "h2").toPandas()
        exact = np.sort(np.ascontiguousarray(exact.to_numpy("<i8").reshape(-1, 2)).view("S16").ravel())
        parts = [(r.shard, np.frombuffer(r.table, np.uint16)) for r in self.filters().collect()]
        known = spark.sparkContext.broadcast((exact, parts))

        def dropped(digests: np.ndarray) -> np.ndarray:
            keys, tables = known.value
            out = np.zeros(len(digests), bool)
            h = digests.view("<i8").reshape(-1, 2)
            shard = h[:, 0] % shards
            for s, table in tables:
                at = np.flatnonzero(shard == s)
                if len(table) and len(at):
                    out[at] = CuckooFilter(len(table) // SLOTS, table).contains(h[at, 1])
            at = np.flatnonzero(out)
            if len(at):
                place = np.minimum(np.searchsorted(keys, digests[at]), len(keys) - 1)
                out[at] = keys[place] == digests[at]
            return out

        return self._rewrite(docs, lambda _, digests: dropped(digests))

    def _apply_shuffled(self, docs: DataFrame) -> DataFrame:
        """Frequent keys of each row, found in the filters and settled by a join, come with the row."""
        *_, drop = self._out(docs)
        rid = free_name([*docs.columns, drop], "nf_row")
        docs = staged(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part, ids, found = batch.slice(at, 512), [], []
                    for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        own = {xxhash.xxh3_128_digest(k) for k in line_keys(text)}
                        ids += [i] * len(own)
                        found += own
                    h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["row", "h1", "h2"])

        lines = staged(docs.select(rid, text_bytes().alias("t")).mapInArrow(hashes, "row long, h1 long, h2 long"), "line_keys")
        parts = max(1, -(-lines.count() // (self.shards * PART_KEYS)))
        shard = F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard")
        dealt = lines.select("row", "h1", "h2", shard, F.pmod(F.xxhash64("row", "h2"), F.lit(parts)).cast("int").alias("part"))
        tables = self.filters().select("shard", "table", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        passed = dealt.groupBy("shard", "part").cogroup(tables.groupBy("shard", "part")).applyInArrow(_passed, "row long, h1 long, h2 long")
        frequent = self.refcounts().filter(F.col("n") >= self.min_docs).select("h1", "h2")
        found = passed.join(frequent, ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("h1", "h2")).alias(drop))  # keys of one text
        with_keys = docs.join(found.withColumnRenamed("row", rid), rid, "left").drop(rid)

        def dropped(batch: pa.RecordBatch, digests: np.ndarray, owner: np.ndarray) -> np.ndarray:
            out = np.zeros(len(digests), bool)
            h, sets = digests.view("<i8").reshape(-1, 2), batch.column(batch.schema.get_field_index(drop))
            for i in np.unique(owner):
                if own := sets[int(i)].as_py():
                    keys = {(x["h1"], x["h2"]) for x in own}
                    at = np.flatnonzero(owner == i)
                    out[at] = [(int(a), int(b)) in keys for a, b in h[at]]
            return out

        return self._rewrite(with_keys, dropped, drop)

    def _rewrite(self, docs: DataFrame, dropped, extra: str | None = None) -> DataFrame:
        names = [c for c in docs.columns if c != extra]
        n_lines, n_dropped, body, _ = self._out(docs)
        least = self.min_chars

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 1_024) for b in batches for at in range(0, b.num_rows, 1_024)):
                texts = batch.column(batch.schema.get_field_index(body)).to_pylist()
                keys = [line_keys(t) for t in texts]
                owner = np.repeat(np.arange(len(texts)), [len(k) for k in keys])
                flat = [k for own in keys for k in own]
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), "S16")
                gone = dropped(batch, digests, owner) if extra else dropped(batch, digests)
                gone &= np.fromiter((_long_enough(k, least) for k in flat), bool, len(flat))
                count = np.bincount(owner, gone, len(texts)).astype(np.int64)
                start = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
                for i in np.flatnonzero(count):
                    off = gone[start[i] : start[i + 1]]
                    texts[i] = b"\n".join(line for line, x in zip(texts[i].split(b"\n"), off, strict=True) if not x)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary()), pa.array(np.diff(start)), pa.array(count)], [*names, body, n_lines, n_dropped])

        kept = [f for f in docs.schema.fields if f.name in names and f.name != "text"]
        names = [f.name for f in kept]
        schema = T.StructType([*kept, T.StructField(body, T.BinaryType()), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
        columns = [c for c in docs.columns if c != "text"]
        out = small_batches(docs).select(*columns, text_bytes().alias(body)).mapInArrow(rewrite, schema)
        return out.select(*[F.col(body).cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns if c != extra], n_lines, n_dropped)


def _passed(lines: pa.Table, tables: pa.Table) -> pa.Table:
    """The keys (row, h1, h2) that their shard's filter holds."""
    own = lines.select(["row", "h1", "h2"])
    if not tables.num_rows or not lines.num_rows:
        return own.slice(0, 0)
    table = np.frombuffer(tables["table"][0].as_py(), np.uint16)
    return own.filter(pa.array(CuckooFilter(len(table) // SLOTS, table).contains(own["h2"].to_numpy())))


def _update_filter(key, old, new):
    """One shard: its filter so far, and its keys with step 1 (enters), 0 (stays) or -1 (leaves)."""
    import pandas as pd

    shard = key[0]
    enters, leaves = new.h2[new.step == 1].to_numpy(), new.h2[new.step == -1].to_numpy()
    size = int((new.step >= 0).sum())
    done = False
    if len(old):
        table = np.frombuffer(old.table.iloc[0], np.uint16)
        held = CuckooFilter(len(table) // SLOTS, table)
        if size <= held.table.size * 0.95:
            held.delete(leaves)
            done = held.insert(enters)
    want = size
    while not done:
        held = CuckooFilter.sized(want)
        done = held.insert(new.h2[new.step >= 0].to_numpy())
        want = max(2 * want, 1)
    return pd.DataFrame({"shard": [shard], "keys": [size], "table": [held.table.tobytes()]})


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays of each document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = LineDedup(spark).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}

ORACLE_SQL = {
    "op4_line_dedup": """
WITH lines AS (
  SELECT row_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10),
flagged AS (
  SELECT keyed.*, frequent.key IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY row_id
"""
}
