"""Operators for preparing training data at scale.

Each module holds one operator, its ``op<N>_<name>`` query and, where SQL can state it,
the DuckDB SQL of the same rows.  Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    from . import centroids, decontaminate, line_dedup, lm_score, mixing, periodic_runs, pii, quality, search, secrets_scan, sharding, simhash, toxicity

    return [mixing, line_dedup, pii, secrets_scan, simhash, decontaminate, quality, toxicity, lm_score, search, periodic_runs, sharding, centroids]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ``op<N>_<name>`` queries."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those of the queries that SQL can state."""
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLE_SQL
    return out
