"""LM scoring: counts and base score against Python, the model's score against a plain forward pass."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from nearfold.llm import lm_score
from nearfold.llm.common import fold

from .helpers import edge_rows, table


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [((t or "").encode()).lower().split() for _, t in rows]
    counts, ends = Counter(), 0
    for (i, _), w in zip(rows, words, strict=True):
        if not held(i):
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n, round(base, 4)))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_counts_and_base_score(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(i, f"some words {i} and the rest {i % 3}") for i in range(20, 60)]
    for most in (lm_score.HEAVY, 3):  # the second leaves most words to the join
        monkeypatch.setattr(lm_score, "heavy_words", lambda counts, m=most: HEAVY_WORDS(counts, m))
        got = lm_score.score(table(spark, rows), fold(7, 2)).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=key) == sorted(brute(rows), key=key)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


HEAVY_WORDS = lm_score.heavy_words


def test_no_training_documents_and_empty_table(spark):
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm_score.score(table(spark, [(i, "a b") for i in only]), fold(7, 2)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert lm_score.score(table(spark, []), fold(7, 2)).count() == 0


def model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, lm_score.SUBWORDS) * (rng.random(lm_score.SUBWORDS) < 0.3)
    m = lm_score.LanguageModel(counts, lm_score.read_vocabulary())
    for v in m.net.p.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.3)
    m.net.prepare()
    return m


def test_score_is_that_of_a_plain_forward_pass():
    m = model()
    texts = [[], [b"one"], "the cat sat on the mat and was not seen again by any other cat of that town".encode().split() * 5, [b"\xc3\xa9t\xc3\xa9", b"x" * 300]]
    for most in (10, 200_000):
        got = m.scores([m.read(w)[:2] for w in texts], rows=3, most=most)
        for words, s in zip(texts, got, strict=True):
            ids = [i for w in words for i in lm_score.subwords(w, m.vocabulary)]
            items = m.net.item[ids].astype(int) if ids else np.zeros(0, int)
            seq = [m.end, *items.tolist(), m.end]
            total = -np.log(m.net.never) * (items == m.end - 1).sum()
            for at in range(len(seq) - 1):
                begin = max(0, at // lm_score.STRIDE * lm_score.STRIDE - lm_score.CONTEXT)
                window = np.array([seq[begin : at + 1]])
                assert window.shape[1] <= lm_score.SPAN
                total += m.net.plain(window, np.array([seq[begin + 1 : at + 2]]))[0, -1]
            assert abs(s - total / np.log(10)) < 1e-3 * (1 + abs(s))


def test_probabilities_sum_to_one():
    m = model(1)
    ids = np.full((m.end + 1, 3), 5)
    ids[:, 1] = 900
    goal = ids.copy()
    goal[:, -1] = np.arange(m.end + 1)
    assert abs(np.exp(m.net.plain(ids, goal)[:, -1]).sum() - 1) < 1e-6


def test_windows_hold_the_whole_text():
    m = model(2)
    of = lambda w: np.frombuffer(m.word(w)[0], np.uint16).tolist()
    for text in (b"", b"one two", " ".join(f"word{i}" for i in range(200)).encode()):
        flow = [m.end, *(x for v in text.split() for x in of(v)), m.end]
        rows = m.windows(text)
        assert [r[0] for r in rows[1:]] == [r[-1] for r in rows[:-1]]  # the last target stands before the next
        learnt = [x for r in rows.tolist() for x in r[1:] if x != lm_score.PAD]
        assert learnt == flow[1:] and rows[0][0] == m.end and len(rows) == -(-len(learnt) // lm_score.SPAN)


def test_partitions_change_no_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    two, five = ({r.doc_id: r.score for r in lm_score.score(docs.repartition(n), fold(7, 2)).collect()} for n in (2, 5))
    assert max(abs(two[i] / five[i] - 1) for i in two) < 1e-6


def test_repeated_texts_fall_into_several_parts(spark, monkeypatch):
    """A text that most rows repeat is dealt over parts like any other."""
    seen = []
    monkeypatch.setattr(lm_score, "TASK_WINDOWS", 50)
    monkeypatch.setattr(lm_score, "_averaged", lambda models: seen.append([r.n for r in models.filter("chunk = 0").select("n").collect()]) or np.zeros(0))
    docs = table(spark, [(i, "the same words again and again " * 12) for i in range(300)])
    lm_score.score(docs, F.lit(False)).count()
    assert len(seen) == lm_score.ROUNDS and all(len(n) > 2 and max(n) < 150 for n in seen)


def test_training_lowers_the_loss():
    counts = np.zeros(lm_score.SUBWORDS, int)
    counts[:300] = 1_000 - np.arange(300)
    net = lm_score.Attention(counts)
    flow = np.arange(33) * 9 % 300
    windows = ((np.arange(300)[:, None] * 1 + flow[None, :]) % 300).astype(np.uint16)
    loss = lambda: -net.plain(windows[:, :-1].astype(int), windows[:, 1:].astype(int)).mean()
    before = loss()
    net.fit(windows, passes=60, batch=32)
    assert loss() < before / 2
    assert np.allclose(lm_score.Attention(counts, seed=9).take(net.flat()).flat(), net.flat())


def test_context_helps_on_held_out_documents(spark, monkeypatch):
    """Untrained, the model is the unigram of the subwords; trained, it gives what it never saw a higher probability."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    total = lambda: sum(r.score for r in lm_score.score(docs, fold(7, 2)).filter("held_out").collect())
    trained = total()
    monkeypatch.setattr(lm_score, "train", lambda windows, model: None)
    unigram = total()
    print("held out, log10: trained", trained, "unigram", unigram)
    assert trained > 0.95 * unigram


def test_words_are_encoded_together_as_each_by_itself():
    voc = lm_score.read_vocabulary()
    odd = ["a ", "　b", "x\x1cy", "'s", "n't", " ", "café", "123abc", "-", "\U0001f600\U0001f600", "z" * 3_000, "�"]
    for words in ([], [b"the", b"'s", b"cat's", "été".encode()], [w.encode() for w in odd], [b"\xff\xfe", b"ok", b"\xc3"]):
        ids, size = lm_score.subwords_of(words, voc)
        each = [lm_score.subwords(w, voc) for w in words]
        assert ids.tolist() == [i for e in each for i in e] and size.tolist() == [len(e) for e in each]


def test_words_are_forgotten_and_read_alike(monkeypatch):
    """Tables of words are of bounded size; what a text reads as does not depend on what was read before."""
    monkeypatch.setattr(lm_score, "MEMO", 5)
    m = model(3)
    m.often, m.base = [b"the", b"cat"], np.array([-1.0, -2.0])
    for k in range(30):
        words = b"the cat and the other".split() + [f"word{k}".encode()] * 2
        items, _, base, seen, rest, times = m.read(words)
        assert items == b"".join(m.word(w)[0] for w in words)
        assert (base, seen) == (-4.0, 3) and dict(zip(rest, times, strict=True)) == Counter(words[2:3] + words[4:])
        assert len(m._code) <= 2 + 5 + len(set(words))


def test_every_window_is_dealt_once():
    m = model(4)
    texts = [m.read(t.encode().lower().split())[0] for t in ("", "one two", " ".join(f"w{i} the" for i in range(2_000)))]
    wanted = Counter(w.tobytes() for t in texts for w in lm_score.cut_windows(t, m.end))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(texts, pa.binary())], ["doc_id", "items"])
    got = Counter()
    for r in range(lm_score.ROUNDS):
        for out in lm_score._dealer(r, 3, m.end)(iter([batch])):
            assert set(out.column(0).to_pylist()) <= {0, 1, 2}
            got.update(w.tobytes() for run in out.column(1).to_pylist() for w in lm_score.windows_of(np.frombuffer(run, np.uint16)))
    assert got == wanted


def test_slopes_are_those_of_the_loss():
    """The first step goes against the loss's slope, by finite differences of the plain form, in every kind of parameter."""
    net = model(5).net
    rng = np.random.default_rng(0)
    windows = rng.integers(0, net.end, (6, lm_score.SPAN + 1)).astype(np.uint16)
    windows[-1, 9:] = lm_score.PAD
    before = {k: v.copy() for k, v in net.p.items()}

    def loss():
        ids, goal = windows[:, :-1].astype(int), windows[:, 1:].astype(int)
        live = goal != lm_score.PAD
        return -(net.plain(np.where(ids == lm_score.PAD, net.end, ids), np.where(live, goal, net.end)) * live).sum() / live.sum()

    after = {k: v.copy() for k, v in net.fit(windows, rate=1e-3).p.items()}
    net.p = {k: v.copy() for k, v in before.items()}
    for k in before:
        moved = after[k] - before[k]
        at = np.unravel_index(np.argsort(-np.abs(before[k]) * (moved != 0), axis=None)[:3], moved.shape)
        for i in zip(*at, strict=True):
            ends = []
            for e in (0.05, -0.05):
                net.p[k][i] = before[k][i] + e
                ends.append(loss())
            net.p[k][i] = before[k][i]
            slope = (ends[0] - ends[1]) / 0.1
            assert abs(slope) < 1e-5 or np.sign(slope) == -np.sign(moved[i]), (k, i, slope, moved[i])
