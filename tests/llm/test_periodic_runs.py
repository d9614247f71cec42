"""op11 against brute force: every start, every period, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfold.llm import periodic_runs

from .helpers import edge_rows, save, table

SMALL = "/root/testdata/sf0.001"


def brute(words, min_exp=4, min_len=6):
    """All runs (start, length, period): for each period, by walking over the words."""
    n, seen = len(words), {}
    for p in range(1, n // min_exp + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(min_len, min_exp * p):
                seen.setdefault((i, length), p)  # the least period comes first
            i = max(j, i) + 1
    return sorted(((s, n, p) for (s, n), p in seen.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = None
    for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(brute_collapse(words, runs))
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(periodic_runs.op11_periodic_runs(spark, SMALL))
    assert got == sorted((brute_row(*r) for r in docs), key=str) and sum(r[1] > 0 for r in got) > 20


def some_texts():
    rng = random.Random(5)
    out = []
    for i in range(120):
        words = [rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randrange(0, 90))]
        if words and i % 2:
            p = rng.randrange(1, 9)
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice("xyz") for _ in range(p)] * rng.randrange(3, 9)
        out.append(" ".join(words))
    return [*out, "one " * 300, "a b " * 99 + "a", " ".join(f"w{i % 31}" for i in range(400))]


@pytest.mark.parametrize(("lags", "whole_bytes"), [(1_024, 1 << 16), (3, 0), (1, 100), (1_024, 0)])
def test_ranges_of_lags_find_the_same(spark, lags, whole_bytes):
    texts = some_texts()
    got = periodic_runs.find_runs(table(spark, list(enumerate(texts))), lags=lags, whole_bytes=whole_bytes).collect()
    for r in got:
        words = texts[r.doc_id].split()
        runs = brute(words)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed.split() == brute_collapse(words, runs) and r.text == texts[r.doc_id]
    assert len(got) == len(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 5), st.integers(1, 8))
def test_stretches(words, min_exp, min_len):
    ids = periodic_runs.word_ids([w.encode() for w in words])
    got = periodic_runs.stretches(ids, periodic_runs.all_lags(len(ids), min_exp, min_len), min_exp, min_len)
    assert [tuple(r) for r in got.tolist()] == brute(words, min_exp, min_len)


def test_many_words_take_wider_ids():
    ids = np.arange(70_000).astype(np.uint32)
    ids[60_000:60_040] = np.tile(ids[60_000:60_004], 10)
    assert periodic_runs.word_ids([b"%d" % i for i in range(70_000)]).dtype == np.uint32
    assert periodic_runs.stretches(ids, range(1, 9)).tolist() == [[60_000, 40, 4]]


def test_edge_rows(spark, tmp_path):
    folder = save(table(spark, edge_rows()), tmp_path)
    want = sorted((brute_row(i, t) for i, t, *_ in edge_rows() if not t or len(t) < 60_000), key=str)
    got = rows_of(periodic_runs.op11_periodic_runs(spark, folder))
    assert [r for r in got if r[0] != 7] == want and sum(r[0] == 7 for r in got) == 1


def test_empty_and_clashing_names(spark):
    assert periodic_runs.find_runs(table(spark, [])).count() == 0
    docs = table(spark, [(1, "a " * 8), (2, None)]).withColumn("runs", F.lit(1)).withColumn("nf_row", F.lit(2)).withColumn("my col", F.lit(3))
    for whole in (0, 1_000):
        got = periodic_runs.find_runs(docs, whole_bytes=whole)
        assert got.columns == [*docs.columns, "_runs", "collapsed"]
        assert [(r.text, r.runs, r.nf_row, len(r["_runs"]), r.collapsed) for r in got.orderBy("doc_id").collect()] == [("a " * 8, 1, 2, 1, "a"), ("", 1, 2, 0, "")]
