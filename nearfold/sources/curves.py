"""Text curves, and folders of such files by class; tar tiles of them are in ``tiles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_curve(text: str) -> tuple[list[tuple[float, float, float]], str | None]:
    """Observations (time, magnitude, error) after two lines of preamble and a header, and what went wrong."""
    out = []
    for line in text.splitlines()[3:]:
        if not line.strip():
            continue
        try:
            t, mag, err = map(float, line.split()[:3])
        except ValueError:
            return out, f"bad line: {line[:80]}"
        out.append((t, mag, err))
    return out, None


def read_curve_folder(spark: SparkSession, root: str) -> DataFrame:
    """(id, band, class, t, mag, err) of all ``.mjd`` files below ``root``; class is the folder's name."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mjd").text(root).withColumn("file", F.input_file_name())
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    stem = F.regexp_extract("file", r"([^/]+)\.mjd$", 1)
    rows = lines.select(
        F.regexp_extract(F.regexp_replace(stem, "^lc_", ""), r"^(.*)\.([^.]+)$", 1).alias("id"),
        F.regexp_extract(stem, r"\.([^.]+)$", 1).alias("band"),
        F.element_at(F.split("file", "/"), -2).alias("class"),
        number(1).alias("t"), number(2).alias("mag"), number(3).alias("err"),
    )
    # preamble and header are not three numbers
    return rows.filter(F.col("t").isNotNull() & F.col("mag").isNotNull() & F.col("err").isNotNull())
