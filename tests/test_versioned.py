"""Tables that change by bucket: only touched folders are rewritten, one of two writers wins, old versions go."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nearfold.sources.versioned import Conflict, Manifest, VersionedTable


def rows(spark, items):
    return spark.createDataFrame(items, "id long, v string")


def held(table, version=None):
    return sorted(((r.id, r.v) for r in table.read(version).collect()), key=str)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["id"], buckets=8)
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    assert table.upsert(rows(spark, [(i, "a") for i in range(100)] + [(None, "n")])) == 1
    before = table.manifest.last()[1]["folders"]
    assert table.upsert(rows(spark, [(3, "b"), (3, "c"), (200, "d")])) == 2
    after = table.manifest.last()[1]["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    want = [(i, "a") for i in range(100) if i != 3] + [(3, "c"), (200, "d"), (None, "n")]
    assert held(table) == sorted(want, key=str) and len(held(table, 1)) == 101
    assert table.delete(rows(spark, [(None, "x"), (200, "x")]).select("id")) == 3
    assert held(VersionedTable(spark, str(tmp_path), ["id"], buckets=99)) == sorted([(i, "a") for i in range(100) if i != 3] + [(3, "c")], key=str)


def test_two_writers(spark, tmp_path, monkeypatch):
    """The slower one starts again from the other's version, so neither change is lost."""
    one, two = (VersionedTable(spark, str(tmp_path), ["id"], buckets=4) for _ in range(2))
    one.upsert(rows(spark, [(i, "a") for i in range(20)]))
    plain, calls = Manifest.write, []

    def slow(self, df, bucket):
        if self is two.manifest and not calls:
            calls.append(1)
            one.upsert(rows(spark, [(1, "one"), (50, "one")]))
        return plain(self, df, bucket)

    monkeypatch.setattr(Manifest, "write", slow)
    assert two.upsert(rows(spark, [(1, "two"), (60, "two")])) == 3
    assert dict(held(one)) == {i: "a" for i in range(20)} | {1: "two", 50: "one", 60: "two"}
    with pytest.raises(Conflict):
        one.manifest.commit(3, {})


def test_vacuum(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["id"], buckets=2)
    for v in "abcd":
        table.upsert(rows(spark, [(i, v) for i in range(10)]))
    table.vacuum(2)
    assert table.manifest.versions() == [3, 4] and held(table, 3) == [(i, "c") for i in range(10)]
    table.vacuum()
    assert held(table) == [(i, "d") for i in range(10)] and len([p for p in (tmp_path / "data").iterdir() if not p.name.startswith(".")]) == 1


def test_composite_and_only_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["id", "v"])
    table.upsert(rows(spark, [(1, None), (1, None), (1, "x")]))
    table.upsert(rows(spark, [(1, None), (2, "y")]))
    assert sorted(held(table), key=str) == sorted([(1, None), (1, "x"), (2, "y")], key=str)
    assert table.read().filter(F.col("v").isNull()).count() == 1
