"""Rows of a query held against those of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v) if not isinstance(v, int | str | bool | type(None)) else v


def _sortable(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_sortable)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; nothing where both agree exactly."""
    got_names, got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} but {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows but {len(want)}"]
    return [f"{a} but {b}" for a, b in zip(got, want, strict=True) if a != b or [type(x) for x in a] != [type(x) for x in b]][:3]
