"""op9: held-out accuracy, the model's parts, edge cases."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from nearfold.llm import quality
from nearfold.llm.common import fold

from .helpers import edge_rows, pdf, save, table


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.op9_quality(spark, folder).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    held = got[got.held_out].merge(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").df(), on="doc_id")
    assert len(held) > 1_000 and (held.predicted == held.quality).mean() > 0.98


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4_000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.AdditiveModel(x[:3_000], y[:3_000])
    assert ((model.score(x[3_000:]) >= 0.5) == y[3_000:]).mean() > 0.9
    assert (0, 1) in {tuple(sorted(p[:2])) for p in model.pairs}


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, len(quality.FEATURES))), rng.integers(0, 2, 500)
    m = quality.AdditiveModel(x, y)
    f = m.base
    b = [int(np.searchsorted(e, x[7, j], side="right")) for j, e in enumerate(m.edges)]
    f += sum(t[i] for t, i in zip(m.tables, b, strict=True))
    f += sum(g[b[i] * quality.PAIR_BINS // (len(m.edges[i]) + 1), b[j] * quality.PAIR_BINS // (len(m.edges[j]) + 1)] for i, j, g in m.pairs)
    assert abs(m.score(x[7:8])[0] - 1 / (1 + np.exp(-f))) < 1e-12


def test_edges(spark, tmp_path):
    rows = edge_rows() + [(100 + i, f"a good sentence number {i}, with words.") for i in range(60)] + [(300 + i, "@@## $$ || {}" * (i + 1)) for i in range(60)]
    folder = save(table(spark, rows), tmp_path)
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(60)] + [(101, None, 0), (None, 1, 0), (102, 9, 0)], "doc_id long, quality int, toxic int")
    save(labels, tmp_path, "labels")
    got = pdf(quality.op9_quality(spark, folder), "doc_id", "score")
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (got[got.doc_id >= 300].predicted == 0).all() and (got[(got.doc_id >= 100) & (got.doc_id < 300)].predicted == 1).all()
    none = quality.fit(table(spark, rows), labels.limit(0), "quality", ~fold(3, 1))
    clash = table(spark, rows).withColumnRenamed("lang", "Score")
    out = quality.score(clash, none)
    assert out.columns[-1] == "_score" and {r["_score"] for r in out.collect()} == {0.5}
    assert quality.score(table(spark, []), none).count() == 0


def test_query_equals_a_plain_fit(spark):
    """The scores of the query are those of a model fitted here, on rows chosen in plain Python."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    own = [i for i in docs if i in y and zlib.crc32(str(i).encode()) % 3 != 1]
    assert 20 < len(own) < quality.MAX_TRAIN
    x, t = np.array([quality.features(docs[i]) for i in own]), np.array([y[i] for i in own])
    order = np.lexsort([*x.T, t])
    model = quality.AdditiveModel(x[order], t[order])
    want = dict(zip(docs, model.score(np.array([quality.features(v) for v in docs.values()])), strict=True))
    got = quality.op9_quality(spark, folder).collect()
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-9 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_the_bound_holds_where_ids_repeat(spark):
    docs = table(spark, [(i % 5, f"text {i} of many") for i in range(500)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert quality.examples(docs, labels, "quality", F.lit(True), 2).count() == 2
    assert quality.examples(docs, labels, "quality", F.lit(True), 50).count() == 5
