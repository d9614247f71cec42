"""Shards of near equal bytes by histogram sort: count below candidate boundaries, refine, exchange once.

Every row gets a key: the md5 of its text, the md5 of its doc_id and a row number, so rows stand in
one order in which equal texts are neighbours, and no two rows are alike.  A splitter is a key; the
rows below the i-th splitter shall hold i / n of all bytes.  A round counts, exactly and in all
partitions, the bytes and rows between up to ``PROBES`` candidate keys, and the least and greatest key
found between each two.  Whatever candidate keys enclose a splitter's target become the ends of its
next round, whose candidates divide what lies between the least and greatest key really found there,
so a text that a third of the rows repeat costs two rounds and not one for each of its bits.  A
splitter is settled when the bytes below it are within ``tolerance`` of the target (a share of a shard's
bytes), or nothing lies between its ends but one row; then the nearer end is taken, the lower of
two.  With tolerance 0 each splitter is the best of all places between rows.  The driver sees the
candidates' counts only.

Splitters that cut a shard into pieces, for smaller tasks, are sought in the same rounds with a wider
tolerance.  Each piece is then one partition of the only exchange, sorted by key; as counting told how
many rows stand below every splitter, a row's slot is its place in its piece plus that number.

Defined cases: a null text has no bytes and counts 1, like an empty one, whose group it shares; a null
doc_id has the md5 of the empty text; repeated rows are separate rows; a text larger than a shard
leaves others empty; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, staged

SHARDS = 16
PROBES = 4_096
PIECE_BYTES = 128 << 20
MOST_PIECES = 4_096
LOOSE = 0.1  # of a piece's bytes
WIDE = 40  # bytes of a key
END = (1 << 8 * WIDE) - 1  # no key: none ends in 64 ones


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keyed(docs: DataFrame, size: str, key: str) -> DataFrame:
    """``docs`` with their sizes and keys, written once: row numbers must not change between rounds."""
    body, name = F.coalesce("text", F.lit("")).cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return docs.withColumn(size, byte_size()).withColumn(key, F.unhex(F.concat(F.md5(body), F.md5(name), number)))


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(WIDE, b"\0"), "big")


def _key(number: int) -> bytes:
    return number.to_bytes(WIDE, "big")


def histogram(rows: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, bytes, rows, least key, greatest key) of the rows (key, size) between the candidates, where there are any.

    Bucket b holds the rows with b candidates at or below their key.
    """
    held = rows.sparkSession.sparkContext.broadcast(np.array([_key(p) for p in probes], f"S{WIDE}"))
    names = ["bucket", "bytes", "n", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = held.value, len(held.value) + 1
        total, n = np.zeros(size, np.int64), np.zeros(size, np.int64)
        low, high = np.full(size, b"\xff" * WIDE, f"S{WIDE}"), np.zeros(size, f"S{WIDE}")
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), f"S{WIDE}")
            order = np.argsort(keys)
            keys, sizes = keys[order], batch.column(1).to_numpy()[order]
            bucket, first = np.unique(np.searchsorted(at, keys, side="right"), return_index=True)
            last = np.r_[first[1:], len(keys)]
            if not len(keys):
                continue
            total[bucket] += np.add.reduceat(sizes, first)
            n[bucket] += last - first
            low[bucket] = np.where(keys[first] < low[bucket], keys[first], low[bucket])
            high[bucket] = np.where(keys[last - 1] > high[bucket], keys[last - 1], high[bucket])
        on = np.flatnonzero(n)
        pad = [[x.ljust(WIDE, b"\0") for x in c[on].tolist()] for c in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on]), pa.array(n[on]), *(pa.array(c, pa.binary()) for c in pad)], names)

    found = rows.mapInArrow(run, "bucket long, bytes long, n long, low binary, high binary")
    found = found.groupBy("bucket").agg(F.sum("bytes"), F.sum("n"), F.min("low"), F.max("high")).orderBy("bucket").collect()  # a row per candidate
    return [(b, s, n, _number(bytes(x)), _number(bytes(y))) for b, s, n, x, y in found]


class Splitters:
    """Boundaries counted so far, and those chosen."""

    def __init__(self, total: int, n: int, low: int, high: int) -> None:
        self.total, self.n = total, n
        self.at, self.bytes, self.rows = [0, END], [0, total], [0, n]  # known boundaries, ascending, and what lies below
        self.inner = {0: (low, high)}  # least and greatest key between a boundary and the next

    def add(self, probes: list[int], counted: list[tuple[int, int, int, int, int]]) -> None:
        """The counts of a round whose candidates include every known boundary."""
        size, rows, inner = [0] * (len(probes) + 1), [0] * (len(probes) + 1), {}
        for b, s, n, low, high in counted:
            size[b], rows[b] = s, n
            inner[probes[b - 1] if b else 0] = (low, high)
        self.inner = inner
        self.at = [0, *probes, END]
        below, under = [0], [0]
        for s, n in zip(size, rows, strict=True):
            below.append(below[-1] + s)
            under.append(under[-1] + n)
        self.bytes, self.rows = below, under

    def around(self, i: int, parts: int) -> int:
        """Place of the last known boundary at or below the target i / parts of the bytes."""
        return min(bisect_right(self.bytes, self.total * i, key=lambda b: b * parts) - 1, len(self.at) - 2)

    def nearest(self, i: int, parts: int) -> int:
        """Place of the known boundary nearest to the target; the lower of two."""
        a = self.around(i, parts)
        below, above = (abs(self.bytes[x] * parts - self.total * i) for x in (a, a + 1))
        return a if below <= above else a + 1

    def open(self, i: int, parts: int, tolerance: float) -> bool:
        """Whether a better boundary may be found, and is needed."""
        a = self.around(i, parts)
        low, high = self.inner.get(self.at[a], (0, 0))
        return low != high and abs(self.bytes[self.nearest(i, parts)] * parts - self.total * i) > tolerance * self.total


def split(rows: DataFrame, shards: int, pieces: int, tolerance: float, probes: int = PROBES) -> list[tuple[int, int, int, int]]:
    """(key, bytes below, rows below, shard) of the pieces of all shards, in order; ``rows`` are (key, size)."""
    first = histogram(rows, [])
    if not first:
        return []
    _, total, n, low, high = first[0]
    found, parts = Splitters(total, n, low, high), shards * pieces
    wanted = [(i, parts, LOOSE if i % pieces else tolerance * pieces) for i in range(1, parts)]
    while still := [w for w in wanted if found.open(*w)]:
        ends = sorted({found.around(i, p) for i, p, _ in still})
        each = max(2, probes // len(ends))
        fresh = {found.at[x] for i, p, _ in wanted for x in (found.around(i, p), found.around(i, p) + 1)}
        for a in ends:
            low, high = found.inner[found.at[a]]
            fresh |= {low + 1} | {low + (high - low) * t // each for t in range(1, each + 1)}
        at = sorted(fresh - {0, END})
        found.add(at, histogram(rows, at))
    places = [0, *(found.nearest(i, parts) for i, _, _ in wanted)]
    return [(found.at[x], found.bytes[x], found.rows[x], k // pieces) for k, x in enumerate(places)]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0, probes: int = PROBES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, the place in the shard, from 0 without gaps; dealt by shard, in order of slots."""
    spark = docs.sparkSession
    names = [free_name(docs.columns, c) for c in ("shard", "slot")]
    size, key, piece = (free_name([*docs.columns, *names], c) for c in ("nf_size", "nf_key", "nf_piece"))
    rows = staged(keyed(docs, size, key), "keyed")
    total = rows.agg(F.sum(size)).first()[0] or 0
    least = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    pieces = max(1, min(max(-(-total // (shards * piece_bytes)), least), MOST_PIECES // shards))
    cuts = split(rows.select(key, size), shards, pieces, tolerance, probes)
    held = spark.sparkContext.broadcast(np.array([_key(c[0]) for c in cuts[1:]], f"S{WIDE}"))

    place_of_key = rows.columns.index(key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(place_of_key).to_pylist(), f"S{WIDE}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(held.value, keys, side="right").astype(np.int32))], [*batch.schema.names, piece])

    dealt = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField(piece, T.IntegerType())])).repartitionById(max(1, len(cuts)), F.col(piece)).sortWithinPartitions(piece, key)
    before, first = [], {}
    for _, _, under, s in cuts:
        before.append(under - first.setdefault(s, under))
    of = F.array(*[F.lit(c[3]) for c in cuts]) if cuts else F.array(F.lit(0))
    start = F.array(*[F.lit(b).cast("long") for b in before]) if cuts else F.array(F.lit(0).cast("long"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # place in the partition
    return dealt.select(*docs.columns, F.get(of, F.col(piece)).cast("int").alias(names[0]), (F.get(start, F.col(piece)) + within).alias(names[1]))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = 0.0) -> None:
    """The shards as Parquet folders ``shard=0``, ``shard=1``, ...; rows of a file stand in order of their slots."""
    shard(docs, shards, tolerance).write.partitionBy(free_name(docs.columns, "shard")).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = shard(docs.withColumn("size", byte_size()).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op12_sharding": op12_sharding}



def _crc32_sql(text: str) -> str:
    """CRC-32 of a text in DuckDB: byte by byte, each as two steps through a table of 16."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (c & 1) * 0xEDB88320
        table.append(c)
    step = lambda x: f"xor({x} >> 4, list_extract({table}, CAST({x} & 15 AS INTEGER) + 1))"
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda c: CAST('0x' || c AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda crc, b: {step(step('xor(crc, b)'))}, 4294967295), 4294967295)"


ORACLE_SQL = {
    "op12_sharding": f"""
WITH keyed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS body,
         md5(coalesce(text, '')) || md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
summed AS (
  SELECT *, {_crc32_sql("body")} AS text_crc32 FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY key) AS place,
         CAST(sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS below
  FROM summed),
edges AS (
  SELECT below FROM placed UNION SELECT CAST(sum(size) AS BIGINT) FROM placed),
cuts AS (
  SELECT i, arg_min(below, abs(below * 16 - i * (SELECT max(below) FROM edges)) * 2 + CAST(below * 16 > i * (SELECT max(below) FROM edges) AS BIGINT)) AS cut
  FROM edges, range(1, 16) AS r(i) GROUP BY i),
dealt AS (
  SELECT placed.*, CAST((SELECT count(*) FROM cuts WHERE cut <= below) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
}
