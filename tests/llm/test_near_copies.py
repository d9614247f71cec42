"""The pipeline's copies against all pairs by five-word Jaccard."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from nearfold.llm import near_copies

from .helpers import edge_rows, table

COPIES = dict(corpus_pipeline.STAGES)["copies"]


def brute(rows):
    """{doc_id: least doc_id of its component} over rows with ids."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders, label = {}, list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in holders.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holders[g].append(i)
        near = [j for j, k in shared.items() if 5 * k >= 4 * (len(s) + len(sets[j]) - k)]
        near += [j for j in range(i) if not s and not sets[j]]
        for j in near:
            a, b = top(i), top(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def changed(rng, text, n):
    w = text.split()
    for p in rng.choice(len(w), n, replace=False):
        w[p] = f"other{rng.integers(1000)}"
    return " ".join(w)


def test_every_planted_near_copy_goes(spark):
    rng = np.random.default_rng(7)
    own = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 150))) for i in range(40)]
    near = [(100 + i, changed(rng, t, 1 + i % 3)) for i, t in own[:30]]
    near = [x for x, (_, t) in zip(near, own, strict=False) if brute([(0, t), (1, x[1])])[1] == 0]
    far = [(200 + i, changed(rng, t, 12)) for i, t in own[:10]]
    assert len(near) >= 25
    left = {r.doc_id for r in COPIES(spark, table(spark, own + near + far), None).collect()}
    assert left == {i for i, _ in own + far}


def test_equals_all_pairs_with_large_keys(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rng = np.random.default_rng(8)
    base = " ".join(f"hot{x}" for x in range(150))
    rows += [(10**7 + i, changed(rng, base, int(rng.integers(1, 8)))) for i in range(120)]
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(spark, rows), small=4, run=20).collect()}
    assert got == want
    assert len({v for k, v in want.items() if k >= 10**7}) > 1


def test_edges(spark):
    left = COPIES(spark, table(spark, edge_rows()), None).collect()
    assert sorted((r.doc_id for r in left), key=str) == [1, 4, 5, 7, 8, 9, None]
    assert COPIES(spark, table(spark, []), None).count() == 0


def test_null_ids_and_names_with_spaces(spark):
    docs = table(spark, [(None, "one two three four five six"), (None, "one two three four five six"), (3, "other words that stand here alone")]).withColumnRenamed("lang", "my lang").withColumn("n-1", F.array(F.struct(F.lit(1).alias("a b"))))
    out = near_copies.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == 2


def test_long_texts_meet_in_smaller_blocks(spark, monkeypatch):
    """A key of long texts is cut by their shingles; the components stay."""
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3)]
    shared = " ".join(f"s{j}" for j in range(240))
    docs = table(spark, [(i, f"{shared} {body[i % 3]} end{i}") for i in range(40)])
    before = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, small=2, run=8).collect()}
    monkeypatch.setattr(near_copies, "RUN_WORDS", 700)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs, small=2, run=8).collect()} == before


def test_scratch_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("nearfold.shared.shared_dir", lambda spark: f"file://{tmp_path}")
    out = near_copies.drop_copies(table(spark, [(i, f"some words that repeat here {i % 3}") for i in range(30)]))
    left = [p.name for p in (tmp_path / "nearfold").glob("*/*")]
    assert left == ["near"] and out.count() == 3


def test_golay_keys_give_the_first_links(spark, monkeypatch):
    """Without any pair by prefix keys, close copies are still found by their fingerprints, and others are refused by their texts."""
    rng = np.random.default_rng(11)
    own = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 1500))) for i in range(30)]
    near = [(100 + i, changed(rng, t, 1)) for i, t in own]
    want = brute(own + near)
    monkeypatch.setattr(near_copies, "_enough", lambda grouped: grouped.select("a", "b").limit(0))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(spark, own + near)).collect()}
    assert all(got[d] in (d, want[d]) for d in got)
    assert sum(got[100 + i] == i for i, _ in own) > 20
    # texts are asked, not fingerprints alone
    monkeypatch.setattr(near_copies, "fingerprint", lambda h: 7)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(spark, own)).collect()}
    assert got == {i: i for i, _ in own}
