"""Mixing sources to target weights by systematic sampling, DataFrame functions only.

Within a source every document has the same expected number of copies, target / size of the
source.  Documents stand in one order per source (size, then md5 of the id, then the id), the
expected copies are summed along that order, one random offset per source is added, and a
document is emitted once for every integer boundary its interval crosses.  Ordering by size makes
each stretch of the order alike, so the words taken stay within about one large document of the
target.

The prefix sum is distributed: rows are range-partitioned on (source, order), sorted within
partitions, and the counts of the ranges, one row per partition and source, give the offsets.  So
a source that holds a third of all rows is dealt over many tasks, and no window sees a whole
source.

Defined cases: a null text has size 0; null sources form one source, last in order; a null doc_id
sorts first and is kept; repeated rows are separate rows; a source of size 0 has target 0 and
takes nothing; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, free_name, staged

SEED = "mix-1"
MAX_REPEAT = 3
MAX_RANGES = 200_000


def word_count(text: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``rows`` with their place in the order, from 0, in ``number``; no task sees more than a range of them."""
    at, part, first = (free_name([*rows.columns, number], c) for c in ("nf_at", "nf_part", "nf_first"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    out = staged(out.withColumn(part, F.shiftright(at, 33)), "ranged")
    counts = out.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias(first)).orderBy(part).collect()  # a row per partition
    before, total = [], 0
    for r in counts:
        before.append((r[part], total - r[first]))
        total += r.n
    shift = rows.sparkSession.createDataFrame(before, f"`{part}` long, `{first}` long")
    return out.join(F.broadcast(shift), part).withColumn(number, F.col(at) + F.col(first)).drop(at, part, first)  # `parts` rows


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets per source from (source, size, ...) rows: one row per source.

    Sources by code point, null last, weigh 1, 2, 3 in turn and share the total size; targets stop
    at ``max_repeat`` times the source's size and the excess is shared again by weight.  That is the
    level t with sum(min(cap, t * weight)) = total.  It is reached from below: sources capped at a level
    stay so, and the others share what is left, until none is above; each turn is one sum over sources.
    """
    per = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "per_source")
    per = numbered(per, [F.col("source").isNull(), F.col("source").cast("binary")], "nf_rank")
    per = staged(per.withColumn("w", F.col("nf_rank") % 3 + 1).withColumn("cap", F.col("source_size") * max_repeat), "weighted")
    level, capped = 0.0, -1
    while True:
        on = F.col("cap") < F.lit(level) * F.col("w")
        r = per.agg(F.sum("source_size"), F.sum(F.when(on, F.col("cap"))), F.sum(F.when(~on, F.col("w"))), F.count(F.when(on, 1))).first()
        if r[0] is None or r[2] is None or r[3] == capped:
            break
        level, capped = (r[0] - (r[1] or 0)) / r[2], r[3]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w")).alias("target"))


def _offset(seed: str) -> Column:
    """A number in [0, 1) for each source, the same in every run."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("\u0000")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _taken(rows: DataFrame, seed: str, max_repeat: int) -> DataFrame:
    """(source, size, h, doc_id, ...) rows with source_size, target and copies."""
    targets = staged(source_targets(rows.select("source", "size"), max_repeat), "targets")
    # what is alike in all columns is interchangeable, so any last order splits it
    tie = [F.xxhash64(F.col(c)) for c, kind in rows.dtypes if c not in ("source", "size", "h", "doc_id") and "map<" not in kind] + [F.monotonically_increasing_id()]
    order = [F.col("source").isNull(), F.col("source").cast("binary"), "size", "h", "doc_id", *tie]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = staged(ranged.withColumn("part", F.shiftright("at", 33)), "ranged")
    ranges = ranged.groupBy("source", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = ranges.join(targets, ranges["source"].eqNullSafe(targets["source"])).select(
        ranges["source"].alias("src"), F.col("part").alias("prt"), "first", "before", "source_size", "target"
    )
    rank = F.col("at") - F.col("first") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((rank + 1) * rate + _offset(seed)) - F.floor(rank * rate + _offset(seed))
    # one row per partition and source: at most (partitions + sources) rows; beyond MAX_RANGES by shuffle
    ranges = staged(ranges, "ranges")
    small = ranges.count() <= MAX_RANGES
    out = ranged.join(F.broadcast(ranges) if small else ranges, (ranged["part"] == F.col("prt")) & ranged["source"].eqNullSafe(F.col("src")))
    return out.withColumn("copies", F.least(crossed, F.lit(max_repeat)).cast("long"))


def _hash() -> Column:
    return F.md5(F.col("doc_id").cast("string").cast("binary"))


def copies(docs: DataFrame, seed: str = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``."""
    sized = staged(docs.select("doc_id", "source", word_count().alias("size"), _hash().alias("h")), "sizes")
    return _taken(sized, seed, max_repeat).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, with a column ``copy``.

    Rows go along with their sizes, so no key joins them; rows that repeat a doc_id stand in the order
    of their other columns.
    """
    number = free_name(docs.columns, "copy")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    sized = docs.select("doc_id", "source", word_count().alias("size"), _hash().alias("h"), row)
    taken = _taken(sized, seed, max_repeat).select("row", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int"))).alias("nf_copy")).filter("nf_copy > 0")
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("nf_copy").alias(number))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    out = copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES = {"op3_mixing": op3_mixing}

ORACLE_SQL = {
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM per),
tg AS (
  SELECT source, source_size,
         coalesce(least(CAST(cap AS DOUBLE), (SELECT arg_min(level, 3 * source_size / w) FROM lev WHERE level * w <= cap) * w), 0.0) AS target,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(source, chr(0))), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM lev),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id NULLS FIRST) - 1 AS k FROM sized s),
taken AS (
  SELECT doc_id, size, source_size, target,
         CAST(least(floor((k + 1) * r + u) - floor(k * r + u), 3) AS BIGINT) AS copies
  FROM (SELECT ranked.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r
        FROM ranked JOIN tg ON ranked.source IS NOT DISTINCT FROM tg.source))
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
}
