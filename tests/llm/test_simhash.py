"""op7 against all pairs, and the properties its keys rest on."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import xxhash

from nearfold.llm import simhash

from .helpers import edge_rows, pdf, save, table


def brute(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    label = list(range(len(rows)))
    u = np.array(out, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 3):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            ids[x] = min(ids.get(x, i), i)
    return sorted(((i, f"{f:016x}", ids.get(x)) for (i, _), f, x in zip(rows, out, label, strict=True)), key=str)


def result(df):
    return sorted(((None if r[0] is None else int(r[0]), r[1], r[2]) for r in df.collect()), key=str)


def test_query_equals_all_pairs(spark, tmp_path):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()[:400]
    rows += [(i if i is None else i + 10**7, t[0]) for i, *t in edge_rows()]
    base = " ".join(f"word{i}" for i in range(120))
    rows += [(10**8 + i, base.replace(f"word{i} ", f"other{i} ")) for i in range(60)]
    assert result(simhash.op7_simhash(spark, save(table(spark, rows), tmp_path))) == brute(rows)


def test_golay_tables_and_keys_lose_nothing():
    code = simhash.Golay.get()
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 4000)
    near = (v ^ code.leader[code.syndrome(v)])
    assert (code.syndrome(near) == 0).all() and (np.bitwise_count(near ^ v) <= 3).all()
    fp = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)
    for _ in range(8):
        other = fp.copy()
        for _ in range(3):
            other ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
        a, b = simhash.keys(fp), simhash.keys(other)
        mine, theirs = set(zip(*map(np.ndarray.tolist, a), strict=True)), set(zip(*map(np.ndarray.tolist, b), strict=True))
        assert {r for r, _ in mine & theirs} == set(range(len(fp)))


def test_large_keys_go_through_tiles(spark):
    rng = np.random.default_rng(2)
    near = {int(x) for x in (np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))).view(np.int64)}
    distinct = spark.createDataFrame([(x,) for x in near], "fp long")
    few = pdf(simhash.components(simhash.links(distinct, run=4)), "node")
    many = pdf(simhash.components(simhash.links(distinct)), "node")
    assert few.equals(many) and len(few)


def test_empty_and_chain(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(chain).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1001] == 1000


def test_large_keys_are_cut_while_they_are_read():
    """A key of any number of rows is passed on in blocks; other keys are compared in place."""
    rng = np.random.default_rng(2)
    key = np.r_[np.zeros(40), np.full(150_001, 5), np.full(30, 6), np.full(70_000, 7), [8, 9]].astype(np.int64)
    fp = rng.integers(-(2**62), 2**62, len(key))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[at : at + 9_973]), pa.array(fp[at : at + 9_973])], ["key", "fp"]) for at in range(0, len(key), 9_973)]
    out = pa.Table.from_batches(list(simhash._linker(1_000)(iter(batches)))).to_pandas()
    large = out[out.block.notna()]
    assert sorted(large.a.unique()) == [5, 7]
    for k in (5, 7):
        own = large[large.a == k]
        assert sorted(own.b) == sorted(fp[key == k]) and own.groupby("block").size().max() <= 1_000 and own.block.nunique() == own.block.max() + 1
