"""op12 against its SQL, against the best boundaries by hand, and with a text in a third of the rows."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from nearfold.llm import sharding

from ..oracle import database, differences
from .helpers import edge_rows, save, table

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("parts", ["2", "40"])
def test_rows_agree_with_sql(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert differences(sharding.op12_sharding(spark, SMALL), database(SMALL), sharding.ORACLE_SQL["op12_sharding"]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_edge_rows(spark, tmp_path):
    folder = save(table(spark, edge_rows()), tmp_path)
    con = database(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert differences(sharding.op12_sharding(spark, folder).drop("text_crc32"), con, f"SELECT * EXCLUDE (text_crc32) FROM ({sharding.ORACLE_SQL['op12_sharding']})") == []
    for r in sharding.op12_sharding(spark, folder).join(table(spark, edge_rows()).filter("doc_id <> 6"), "doc_id").collect():
        assert r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] == len((r.text or "").encode()) + 1


def gapless(rows):
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def hot_rows():
    return [(None, "hot text " * 20) for _ in range(700)] + [(i % 900, f"text {i} " * (i % 40)) for i in range(1_300)]


@pytest.mark.parametrize(("shards", "probes", "piece_bytes"), [(16, 4_096, 128 << 20), (7, 32, 10_000), (3, 8, 1_000)])
def test_a_hot_text_is_cut_where_bytes_ask_for_it(spark, shards, probes, piece_bytes):
    docs = table(spark, hot_rows()).withColumn("row", F.monotonically_increasing_id()).repartition(5)
    got = sharding.shard(docs, shards, probes=probes, piece_bytes=piece_bytes).collect()
    assert len(got) == 2_000 and len({r.row for r in got}) == 2_000 and gapless(got)
    size = lambda r: len(r.text.encode()) + 1
    total, most = sum(map(size, got)), max(map(size, got))
    held = [sum(size(r) for r in got if r.shard == s) for s in range(shards)]
    assert all(abs(b - total / shards) <= most for b in held)
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert sum(len(w) - 1 for w in where.values()) <= shards - 1  # a text is in two shards only where a cut falls in it


def test_tolerance_saves_rounds(spark, monkeypatch):
    docs, calls = table(spark, hot_rows()), []
    counted = sharding.histogram
    monkeypatch.setattr(sharding, "histogram", lambda rows, probes: calls.append(len(probes)) or counted(rows, probes))
    got = sharding.shard(docs, 4, tolerance=0.2, probes=64).collect()
    wide = len(calls)
    sharding.shard(docs, 4, tolerance=0.0, probes=64).count()
    size = lambda r: len(r.text.encode()) + 1
    total = sum(map(size, got))
    ends = [sum(size(r) for r in got if r.shard <= s) for s in range(3)]
    assert all(abs(e - total * (s + 1) / 4) <= 0.2 * total / 4 for s, e in enumerate(ends)) and wide < len(calls) - wide


def test_one_exchange_moves_the_rows(spark):
    plan = sharding.shard(table(spark, hot_rows()), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_write_empty_and_clashing_names(spark, tmp_path):
    assert sharding.shard(table(spark, [])).count() == 0
    docs = table(spark, [(i, f"t {i}") for i in range(50)]).withColumn("slot", F.lit("mine")).withColumn("nf_key", F.lit(1)).withColumn("my col", F.lit(2))
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(got.columns) == sorted([*docs.columns, "shard", "_slot"]) and got.count() == 50 and got.select("shard").distinct().count() == 4


def test_a_text_larger_than_a_shard(spark):
    got = sharding.shard(table(spark, [(i, "x" * (100_000 if i == 3 else 10)) for i in range(20)]), 4).collect()
    assert len(got) == 20 and gapless(got) and all(0 <= r.shard < 4 for r in got)
