"""The pipeline: each stage against a plain version on its own input, then all together."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from nearfold.llm import decontaminate as dc
from nearfold.llm import line_dedup, mixing, quality

from .helpers import edge_rows, save, table
from .test_near_copies import brute as all_pairs

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["quality", "lines", "copies", "benchmark", "mix"]

    kept = stages["quality"](spark, docs, SMALL)
    scores = {r.doc_id: r.score for r in quality.op9_quality(spark, SMALL).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.5}

    lines = stages["lines"](spark, kept, SMALL)
    texts = {r.doc_id: r.text for r in kept.collect()}
    held: dict[bytes, int] = {}
    for t in texts.values():
        for k in set(line_dedup.line_keys(t.encode())):
            held[k] = held.get(k, 0) + 1
    for r in lines.collect():
        own = texts[r.doc_id].encode()
        want = b"\n".join(x for x, k in zip(own.split(b"\n"), line_dedup.line_keys(own), strict=True) if not k or held[k] < 10).decode()
        assert r.text == want and r.n_chars == len(want)
    assert lines.columns == columns and lines.count() == len(texts)

    copies = stages["copies"](spark, lines, SMALL)
    component = all_pairs([(r.doc_id, r.text) for r in lines.collect()])
    assert copies.columns == columns and {r.doc_id for r in copies.collect()} == set(component.values())

    clean = stages["benchmark"](spark, copies, SMALL)
    leaks = {r.doc_id for r in dc.leaks(copies, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in clean.collect()} == set(component.values()) - leaks

    mixed = stages["mix"](spark, clean, SMALL)
    assert mixed.count() == sum(r["copies"] for r in mixing.copies(clean).collect())
    assert rows(corpus_pipeline.run(spark, SMALL)) == rows(mixed)


def test_edges(spark, tmp_path):
    folder = save(table(spark, edge_rows()), tmp_path)
    for name in ("labels", "benchmark"):
        save(spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0), tmp_path, name)
    # no label: all score 0.5 and stay; no line is in ten documents; of copies and empty texts one stays
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    left = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert set(left) == {1, 4, 5, 7, 8, 9, None} and docs.count() == 7
    assert all(left[i] == (plain[i] or "", len(plain[i] or "")) for i in left)
    taken = {r.doc_id: r["copies"] for r in mixing.copies(docs).collect()}
    mixed = [(r.doc_id, r["copy"]) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(mixed, key=str) == sorted(((i, c) for i, n in taken.items() for c in range(1, n + 1)), key=str)
    empty = save(table(spark, []), tmp_path / "empty")
    for name in ("labels", "benchmark"):
        save(spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0), tmp_path / "empty", name)
    assert corpus_pipeline.run(spark, empty).count() == 0
    extra = table(spark, edge_rows()).selectExpr("*", "1 as score", "2 as n_lines", "3 as nf_id", "4 as copy")
    docs = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == extra.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns == [*extra.columns, "_copy"]


def test_planted_copies_and_leaks_go_and_clean_documents_stay(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(3_000)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    bench = [(i, prose(40)) for i in range(5)]
    own = [(i, prose(150)) for i in range(60)]
    copies = [(100 + i, own[i][1]) for i in range(10)]
    near = [(200 + i, " ".join(w if j != 75 else "changed" for j, w in enumerate(own[20 + i][1].split()))) for i in range(10)]
    leaked = [(300 + i, prose(60) + " " + bench[i][1] + " " + prose(60)) for i in range(5)]
    folder = save(table(spark, own + copies + near + leaked), tmp_path)
    save(spark.createDataFrame(bench, "item_id long, text string"), tmp_path, "benchmark")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    found = {r.doc_id for r in docs.collect()}
    assert found == {i for i, _ in own}  # one of 150 words changed: a similarity of 0.93
