"""The queries of the engine by name, and the DuckDB SQL of the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curves, search, storage, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = vectors.QUERIES | search.QUERIES | curves.QUERIES | storage.QUERIES
ORACLE_SQL: dict[str, str] = vectors.ORACLE_SQL | search.ORACLE_SQL | curves.ORACLE_SQL | storage.ORACLE_SQL
