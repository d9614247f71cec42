"""op2: the search against brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from nearfold.llm import toxicity
from nearfold.llm.common import fold

from .helpers import edge_rows, pdf, save, table


def test_block_search_equals_brute_force():
    rng = np.random.default_rng(4)
    start, terms, weights, full = [0], [], [], np.zeros((700, 60))
    for e in range(700):
        t = np.sort(rng.choice(60, rng.integers(0, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        w /= np.sqrt((w**2).sum()) if len(t) else 1.0
        full[e, t] = w
        start.append(start[-1] + len(t))
        terms.append(t)
        weights.append(w)
    index = toxicity.BlockMaxIndex.of_vectors(np.array(start), np.concatenate(terms), np.concatenate(weights), 60)
    held = full.astype(np.float32).astype(float)  # what the index holds
    asked = list(range(0, 700, 3))
    for q, got in zip(asked, index.top([(terms[q], weights[q]) for q in asked], 15, asked), strict=True):
        cosine = (held @ full[q]).round(12)
        cosine[q] = 0
        order = [i for i in np.lexsort([np.arange(700), -cosine]) if cosine[i] > 0][:15]
        assert [e for e, _ in got] == order
        assert np.allclose([c for _, c in got], cosine[order])


def many_vectors(n=3_000, size=4_000, seed=2):
    """Vectors whose common terms weigh little, as common words do; some are near copies of others."""
    rng = np.random.default_rng(seed)
    share = np.r_[np.linspace(0.7, 0.05, 60), np.full(size - 60, 0.004)]
    weight = -np.log(share)
    start, terms, weights = [0], [], []
    for e in range(n):
        t = terms[-5][rng.random(len(terms[-5])) < 0.9] if e > 9 and e % 5 == 0 else np.flatnonzero(rng.random(size) < share)
        w = weight[t] * rng.integers(1, 3, len(t))
        start.append(start[-1] + len(t))
        terms.append(t)
        weights.append(w / np.sqrt((w**2).sum()) if len(t) else w)
    return np.array(start), terms, weights, size


def test_most_postings_are_skipped(monkeypatch):
    """Under half of what summing all lists takes, and not one neighbour lost."""
    start, terms, weights, size = many_vectors()
    index = toxicity.BlockMaxIndex.of_vectors(start, np.concatenate(terms), np.concatenate(weights), size)
    index.watch = True
    monkeypatch.setattr(toxicity, "FEW", 100)
    asked = list(range(0, 3_000, 30))
    full = np.zeros((3_000, size))
    for e, (t, w) in enumerate(zip(terms, weights, strict=True)):
        full[e, t] = w.astype(np.float32)
    for q, got in zip(asked, index.top([(terms[q], weights[q]) for q in asked], 15), strict=True):
        cosine = (full[:, terms[q]] @ weights[q]).round(12)
        order = [i for i in np.lexsort([np.arange(3_000), -cosine]) if cosine[i] > 0][:15]
        assert [e for e, _ in got] == order
    assert index.scored < 0.5 * index.whole


def test_fewer_examples_of_longer_texts(spark, monkeypatch):
    docs = table(spark, [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    some = toxicity._examples(docs, labels, "toxic", F.lit(True))
    assert some.count() == 200
    monkeypatch.setattr(toxicity, "POSTINGS", 2_000)
    assert 15 <= toxicity._examples(docs, labels, "toxic", F.lit(True)).count() < 60


def test_query_equals_brute_force(spark):
    """The nearest of every document, the votes and the scores, from vectors over all terms made here in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", ~fold(5, 0))[0].value
    count = toxicity.TermCounter()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    held = {i: dict(zip(*(x.tolist() for x in own), strict=True)) for i, own in zip(texts, count(list(texts.values())), strict=True)}
    df: dict[int, int] = {}
    for h in held.values():
        for t in h:
            df[t] = df.get(t, 0) + 1
    terms = sorted({t for i in model.ids for t in held[i]})
    assert model.table.tolist() == terms
    y = dict(zip(model.ids, model.y.tolist(), strict=True))
    ones, zeros = sum(y.values()), len(y) - sum(y.values())

    def factor(t):
        a = sum(y[i] for i in model.ids if t in held[i])
        c = sum(1 - y[i] for i in model.ids if t in held[i])
        cells = [(a, a + c, ones), (ones - a, len(y) - a - c, ones), (c, a + c, zeros), (zeros - c, len(y) - a - c, zeros)]
        g2 = 2 * sum(x * np.log(x * len(y) / (r * k)) for x, r, k in cells if x > 0)
        return (np.log((len(texts) + 1) / (df[t] + 1)) + 1e-6) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * (max(0, g2) / (max(0, g2) + toxicity.HALF)) ** 2)

    weight = {t: factor(t) for t in terms}

    def vector(h):
        v = {t: (1 + np.log(n)) * weight[t] for t, n in h.items() if t in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(held[i]) for i in model.ids}
    rows = {r.doc_id: r for r in toxicity.score(docs, labels, "toxic", ~fold(5, 0)).collect()}
    prior = (ones + 1) / (len(y) + 2)

    def nearest(q, without=None):
        cosine = sorted(((sum(x * v.get(t, 0) for t, x in q.items()), -e) for e, v in vectors.items() if e != without), reverse=True)
        return [(c, -e) for c, e in cosine[: toxicity.K] if c > 0]

    def vote(near):
        w = [1 / (toxicity.SOFT + max(0.0, 1 - c)) for c, _ in near]
        return (sum(x * y[e] for x, (_, e) in zip(w, near, strict=True)) + prior) / (sum(w) + 1)

    learnt = sorted((vote(nearest(vectors[e], e)), y[e]) for e in vectors if held[e])
    slope, offset = toxicity._logistic(np.array([v for v, _ in learnt]), np.array([float(b) for _, b in learnt]))
    for i, h in held.items():
        near = nearest(vector(h))
        assert np.allclose([e.cosine for e in rows[i].evidence], [c for c, _ in near[:3]], atol=1e-6), i
        if near:
            v = vote(near)
            assert abs(rows[i].score - 1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + offset)))) < 1e-3, i


def test_held_out_accuracy(spark):
    """All held-out rows, also those of low quality, whose label the text may not show."""
    folder = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, folder).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{folder}/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    recall = lambda x: (x[x.toxic == 1].predicted == 1).mean()
    print("held out:", len(held), "accuracy", (held.predicted == held.toxic).mean(), "recall", recall(held), "of quality 1", recall(held[held.quality == 1]), "of quality 0", recall(held[held.quality == 0]))
    assert (held.predicted == held.toxic).mean() > 0.97
    assert recall(held) > 0.9


def test_edges(spark, tmp_path):
    rows = edge_rows() + [(100 + i, f"clean words number {i} here") for i in range(80)] + [(300 + i, f"you idiot clown {i}") for i in range(40)]
    folder = save(table(spark, rows), tmp_path)
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(80)] + [(300 + i, 1, 1) for i in range(40)] + [(301, 1, None), (None, 1, 1), (302, 0, 7)], "doc_id long, quality int, toxic int")
    save(labels, tmp_path, "labels")
    got = pdf(toxicity.op2_toxicity(spark, folder), "doc_id", "score")
    assert len(got) == len(rows)
    assert (got[got.doc_id >= 300].predicted == 1).all() and (got[(got.doc_id < 300) & (got.doc_id >= 100)].predicted == 0).all()
    named = table(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).selectExpr("*", "1 as score", "2 as evidence", "3 as nf_body")
    out = toxicity.score(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), "toxic", F.lit(True))
    assert out.columns == [*named.columns, "_score", "_evidence"] and out.count() == len(rows)
    assert all(e.doc_id.startswith("d") for r in out.collect() for e in r._evidence)
    none = labels.limit(0)
    assert {r.score for r in toxicity.score(table(spark, rows), none, "toxic", ~fold(5, 0)).select("score").collect()} == {0.5}
    assert toxicity.score(table(spark, []), labels, "toxic", ~fold(5, 0)).count() == 0
