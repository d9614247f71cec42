"""The corpus pipeline: five stages over ``documents``, each by one operator of ``nearfold.llm``.

Every stage takes (spark, docs, sf_dir) and returns all rows it keeps; its result is written as
Parquet in the shared folder and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``.

* quality: the additive model is fitted on the labelled documents among its input; documents scored
  under 0.5 go.  A null or empty text is scored like any other.
* lines: lines that stand in at least ten documents go; a null text becomes empty; a document stays
  even when all its lines go; ``n_chars`` is counted again.
* copies: texts link at a Jaccard similarity of 0.8 or more over five-word shingles, exactly
  (``near_copies``; op7's query keeps three words and three bits); of each component the document
  with the least doc_id stays; of rows without a doc_id one stays for each set of shingles, if its
  component has no doc_id; of rows that repeat a doc_id one stays.
* benchmark: documents with a leak of a benchmark item go.
* mix: every document as often as systematic sampling takes it, numbered in ``copy``.

An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import decontaminate, line_dedup, mixing, near_copies, quality
from nearfold.llm.common import documents, fold, free_name, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~fold(3, 1))
    out = free_name(docs.columns, "score")
    return quality.score(docs, model).filter(F.col(out) >= 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.LineDedup(spark).insert(docs).apply(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return out.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("copies", drop_copies), ("benchmark", drop_leaks), ("mix", mix_sources)]

#: The first stage is a fitted model; a brute-force version of all stages is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
