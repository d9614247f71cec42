"""op1 against every alignment of every item, and planted leaks."""

from __future__ import annotations

from itertools import combinations
from math import ceil

import duckdb
import numpy as np

from nearfold.llm import decontaminate as dc

from .helpers import edge_rows, save, table


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items):
    """(doc_id, item_id) of every leak with 15 or more tokens and at most three substitutions there, by all alignments."""
    out = set()
    for d, text in docs:
        words = dc.tokens((text or "").encode())
        for i, item in items:
            own = dc.tokens((item or "").encode())
            if len(own) < dc.MIN_ITEM:
                continue
            for shift in range(-len(own) + 1, len(words)):
                lo, hi = max(0, shift), min(len(words), shift + len(own))
                same = np.array([words[p] == own[p - shift] for p in range(lo, hi)])
                matched, length, _ = dc._stretch(same)
                if matched >= min(dc.MIN_MATCH, ceil(dc.IDENTITY * len(own))) and matched >= dc.IDENTITY * length:
                    out.add((d, i))
    return out


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_masks_meet_every_window():
    """15 tokens with up to three substitutions hold a whole mask somewhere."""
    places = [{at + o for o in m} for m in dc.MASKS for at in range(15 - m[-1])]
    for n in range(4):
        for wrong in combinations(range(15), n):
            assert any(not p & set(wrong) for p in places)


def test_query_equals_all_alignments(spark, tmp_path):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by length(text) limit 120").fetchall()
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    rng = np.random.default_rng(3)
    for n, (i, text) in enumerate(items[:20]):
        words = text.split()
        for k in (0, 1, 3):
            part = list(words)
            for p in rng.choice(len(part), min(k, len(part)), replace=False):
                part[p] = "zzz"
            docs.append((10**6 + 10 * n + k, "before it " + " ".join(part) + " and after it"))
        docs.append((10**6 + 10 * n + 5, "clean: " + " ".join(rng.permutation(words))))
    folder = save(table(spark, docs), tmp_path)
    save(items_table(spark, items), tmp_path, "benchmark")
    assert pairs(dc.op1_decontaminate(spark, folder)) == brute(docs, items)


def test_blocks_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole, split = dc.leaks(docs, bench), dc.leaks(docs, bench, block_tokens=300)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(whole) == key(split) and whole.count() > 0
    gone = {r.doc_id for r in whole.collect()}
    kept = {r.doc_id for r in dc.decontaminate(docs, bench, block_tokens=300).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - gone


def test_edges(spark):
    docs = table(spark, edge_rows() + [(50, "The quick, brown fox! jumps over a LAZY dog")])
    bench = items_table(spark, [(1, None), (2, ""), (3, "too short"), (None, "the quick brown fox jumps over a lazy dog"), (5, "the quick brown fox jumps over a lazy dog")])
    assert pairs(dc.leaks(docs, bench)) == {(50, None), (50, 5)}
    assert dc.leaks(table(spark, []), bench).count() == dc.leaks(docs, bench.limit(0)).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == docs.count()
    clash = docs.withColumnsRenamed({"lang": "nf_leaks", "source": "leaks"})
    assert dc.decontaminate(clash, bench).columns == clash.columns
    assert dc.decontaminate(clash, bench).count() == docs.count() - 1
