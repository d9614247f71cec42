"""op3 against its SQL and a plain pass over each source."""

from __future__ import annotations

import hashlib
import math
import re

import pytest

from nearfold.llm import mixing

from ..oracle import database, differences
from .helpers import edge_rows, save, table

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("parts", ["1", "8"])
def test_rows_agree_with_sql(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert differences(mixing.op3_mixing(spark, SMALL), database(SMALL), mixing.ORACLE_SQL["op3_mixing"]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_edge_rows_agree_with_sql(spark, tmp_path):
    rows = [(*r, "s")[:3] if len(r) == 2 else r for r in edge_rows()] + [(20, "a b c", "\U0001f600"), (21, "a b", "z"), (22, None, None), (23, "", "empty")]
    folder = save(table(spark, rows), tmp_path)
    con = database(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert differences(mixing.op3_mixing(spark, folder), con, mixing.ORACLE_SQL["op3_mixing"]) == []


def targets(sizes):
    """By hand: share by weight, stop at three times the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        free -= full
    return out


def test_targets_and_taken(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.copies(docs).toPandas()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = targets(sizes)
    for s, g in got.groupby("source"):
        assert math.isclose(g.target.iloc[0], want[s], rel_tol=1e-9) and (g.source_size == sizes[s]).all()
        assert abs((g["size"] * g["copies"]).sum() - want[s]) <= 2 * g["size"].max()
        assert g["copies"].between(0, 3).all()
        order = sorted(zip(g["size"], (hashlib.md5(str(i).encode()).hexdigest() for i in g.doc_id), g.doc_id, g["copies"], strict=True))
        rate = want[s] / sizes[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{s}".encode()).hexdigest()[:12], 16) / 2**48
        assert [c for *_, c in order] == [math.floor((k + 1) * rate + u) - math.floor(k * rate + u) for k in range(len(order))]


def test_capped_sources(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(200, "x y", "b"), (201, "x", "c")]
    got = {r.source: r.target for r in mixing.source_targets(mixing.copies(table(spark, rows)).select("source", "size")).collect()}
    assert got == {k: pytest.approx(v) for k, v in targets({"a": 1000, "b": 2, "c": 1}).items()}


def test_mix_writes_each_copy_and_keeps_columns(spark):
    rows = edge_rows() + [(i, f"text {i}", "s" if i % 2 else "t") for i in range(30, 60)]
    docs = table(spark, rows).withColumnRenamed("lang", "copy")
    got, taken = mixing.mix(docs).toPandas(), mixing.copies(docs).toPandas()
    assert list(got.columns) == [*docs.columns, "_copy"] and len(got) == taken["copies"].sum()
    assert len(re.findall("same", " ".join(got.text.dropna()))) == taken[taken.doc_id.isin([5, 6])]["copies"].sum()


def test_empty(spark):
    assert mixing.copies(table(spark, [])).count() == mixing.mix(table(spark, [])).count() == 0
    only = mixing.copies(table(spark, [(1, None), (2, "")])).collect()
    assert {(r.size, r.source_size, r.target, r["copies"]) for r in only} == {(0, 0, 0.0, 0)}
