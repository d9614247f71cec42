"""What the operators of this subpackage share: texts as bytes, folds, tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path, scratch, staged

__all__ = ["WHITE", "WORD", "documents", "fold", "free_name", "new_path", "scratch", "small_batches", "staged", "text_bytes"]

#: Texts that go to Python at once; Spark's own bound, 64 MB, is held several times over by every task.
BATCH_BYTES = 8 << 20

#: ASCII white space: 0x20 and 0x09 to 0x0D, also what ``bytes.split()`` splits at.
WHITE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``."""
    return small_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches to Python of at most ``BATCH_BYTES`` from now on in its session (fewer stay as set)."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id, as text, has this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``taken`` clashes (in any case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted
