"""op4 against its SQL; the filters and the state's reversibility."""

from __future__ import annotations

import numpy as np
import pytest

from nearfold.llm import line_dedup
from nearfold.llm.line_dedup import CuckooFilter, LineDedup

from ..oracle import database, differences
from .helpers import edge_rows, save, table

SMALL = "/root/testdata/sf0.01"


def test_rows_agree_with_sql(spark):
    assert differences(line_dedup.op4_line_dedup(spark, SMALL), database(SMALL), line_dedup.ORACLE_SQL["op4_line_dedup"]) == []


def lines(n=30):
    return edge_rows() + [(100 + i, f" Common Line\t\nown line {i}\n\ncommon line\nÄ common") for i in range(n)]


def test_edge_rows_agree_with_sql(spark, tmp_path):
    folder = save(table(spark, lines()), tmp_path)
    con = database(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert differences(line_dedup.op4_line_dedup(spark, folder), con, line_dedup.ORACLE_SQL["op4_line_dedup"]) == []


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shuffled_path_gives_the_same(spark):
    docs = table(spark, [r for r in lines() if r[0] != 6])
    near = LineDedup(spark).insert(docs)
    far = LineDedup(spark, broadcast_keys=0, keys_per_shard=1).insert(docs)
    assert far.frequent > 1 and far.shards > 1
    assert rows_of(near.apply(docs)) == rows_of(far.apply(docs))


def state(d):
    return rows_of(d.refcounts()), sorted((r.shard, r["keys"]) for r in d.filters().collect() if r["keys"])


def test_insert_and_delete_are_reversible(spark):
    first, more = table(spark, lines(12)), table(spark, [(500 + i, f"late line\nown {i}\ncommon line") for i in range(15)])
    d = LineDedup(spark).insert(first)
    before, clean = state(d), rows_of(d.apply(first))
    d.insert(more)
    assert d.frequent == before[1][0][1] + 1  # "late line"
    both = LineDedup(spark).insert(first.unionByName(more))
    assert rows_of(d.refcounts()) == rows_of(both.refcounts()) and rows_of(d.apply(more)) == rows_of(both.apply(more))
    d.delete(more)
    assert state(d) == before and rows_of(d.apply(first)) == clean
    d.delete(first)
    assert d.refcounts().count() == d.frequent == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5_000)
    f = CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = rng.integers(-(2**63), 2**63 - 1, 20_000)
    assert f.contains(other).mean() < 0.002
    f.delete(keys[:2_500])
    assert f.contains(keys[2_500:]).all() and f.contains(keys[:2_500]).mean() < 0.01
    f.delete(keys[2_500:])
    assert not f.table.any()
    assert not CuckooFilter.sized(4).insert(rng.integers(0, 2**62, 500))


def test_empty_table_and_clashing_columns(spark):
    assert LineDedup(spark).insert(table(spark, [])).apply(table(spark, [])).count() == 0
    docs = table(spark, [(1, "a\nb")]).withColumnsRenamed({"lang": "n_lines", "source": "nf_text"})
    out = LineDedup(spark).insert(docs).apply(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"] and out.first()["_n_lines"] == 2


def test_state_is_opened_again(spark, tmp_path):
    """Two sessions on one folder, and shards that grow more than once."""
    path = f"file://{tmp_path}/state"
    batches = [table(spark, [(1000 * b + i, f"line {b} {i % 7}\nshared\nown {b} {i}") for i in range(70)]) for b in range(3)]
    sessions = [spark, spark.newSession(), spark.newSession()]
    shards = []
    for s, docs in zip(sessions, batches, strict=True):
        d = LineDedup(s, path, keys_per_shard=2)
        d.insert(docs)
        shards.append(d.shards)
    assert shards == sorted(set(shards)) and shards[0] > 1
    again, both = LineDedup(spark, path, keys_per_shard=2), batches[0].unionByName(batches[1]).unionByName(batches[2])
    once = LineDedup(spark).insert(both)
    assert again.version == 3 and again.frequent == once.frequent
    assert rows_of(again.apply(both)) == rows_of(once.apply(both))
    again.delete(batches[2])
    assert rows_of(LineDedup(spark.newSession(), path).refcounts()) == rows_of(LineDedup(spark).insert(batches[0].unionByName(batches[1])).refcounts())


def test_shuffled_path_with_null_and_repeated_ids(spark):
    docs = table(spark, [(None, f"common\nown {i}") for i in range(15)] + [(7, f"common\nother {i % 2}") for i in range(12)])
    near, far = LineDedup(spark).insert(docs), LineDedup(spark, broadcast_keys=0, keys_per_shard=1).insert(docs)
    assert rows_of(near.apply(docs)) == rows_of(far.apply(docs))


def test_shuffled_path_keeps_every_column(spark):
    names = {"lang": "row", "source": "h1", "n_chars": "my col"}
    docs = table(spark, lines()).withColumnsRenamed(names)
    near, far = LineDedup(spark).insert(docs), LineDedup(spark, broadcast_keys=0, keys_per_shard=1).insert(docs)
    assert far.apply(docs).columns == near.apply(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert rows_of(near.apply(docs)) == rows_of(far.apply(docs))


def test_only_touched_shards_are_written(spark):
    docs = table(spark, [(i, f"own line {i}\nshared {i % 40}") for i in range(600)])
    d = LineDedup(spark, keys_per_shard=3).insert(docs)
    assert d.shards >= 8
    before = d.content
    d.insert(table(spark, [(9_000, "own line 5")]))
    changed = [s for s in d.content["counts"] if d.content["counts"][s] != before["counts"].get(s)]
    assert 1 <= len(changed) <= 2 and d.shards == int(before["shards"])  # that of the line, and that of the text
    assert d.manifest.versions() == [1, 2]
    d.insert(table(spark, [(9_001, "own line 6")]))
    assert d.manifest.versions() == [2, 3]  # what only older versions name is gone
    assert LineDedup(spark, d.path).refcounts().count() == 640


def test_foreign_documents_cannot_be_deleted(spark):
    docs = table(spark, [(i, f"a\nb\nown {i % 20}") for i in range(40)])
    d = LineDedup(spark).insert(docs)
    before = state(d)
    for foreign in (table(spark, [(1, "a\nb")]), table(spark, [(1, "a\nb\nown 3")] * 3)):  # lines known, text not, or not as often
        with pytest.raises(ValueError, match="not inserted"):
            d.delete(foreign)
    assert state(d) == before == state(LineDedup(spark, d.path)) and d.version == 1


def test_sessions_that_change_one_state_at_once(spark, tmp_path, monkeypatch):
    """The slower session begins again from the other's version: both batches count."""
    path = f"file://{tmp_path}/state"
    one, two = LineDedup(spark, path), LineDedup(spark.newSession(), path)
    first, second = (table(spark, [(100 * b + i, f"shared\nown {b} {i}") for i in range(8)]) for b in range(2))
    plain, calls = LineDedup._changed, []

    def slow(self, delta):
        out = plain(self, delta)
        if self is two and not calls:
            calls.append(1)
            one.insert(first)
        return out

    monkeypatch.setattr(LineDedup, "_changed", slow)
    two.insert(second)
    once = LineDedup(spark).insert(first.unionByName(second))
    assert two.version == 2 and state(two) == state(once) and two.frequent == 1
