"""The kinds that the methods add, over whole tables against plain Python; long texts whole; the normal tail."""

from __future__ import annotations

import math
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfold.llm import pii, secrets_scan

from .helpers import edge_rows, save, table
from .test_spans import TRICKY, base_pii, base_secrets, luhn

RANDOM = ["Zx9Qw3Rt7Lp2Vb8Nm4Ks6Jh1Gd5Fa0YcUeIo", "qzvkxjwpmbgyfhcludtnsraoei" * 2, "tbnzqvkwxjmrpgyfhcluds", "0123456789" * 4, "aZ3_" * 9, "mF7kQ2xT9bL4vR8sW1jN6cH3dP5gY0zAeUiO" * 20]


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rows += [(10**6 + i, t) for i, t in enumerate(TRICKY)] + [(10**6 + 500 + i, f"see {t} there") for i, t in enumerate(RANDOM)]
    rows += [(10**6 + 700, "bank account DE89370400440532013000 card 3782 822463 10005, tax 078-05-1120, then 378282246310005 far away from any word of that kind at all")]
    return rows + [(-i, t) for i, t, *_ in edge_rows() if i is not None and i not in (6,)]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    return save(table(spark, texts), tmp_path_factory.mktemp("added"))


def mod97(v: str) -> bool:
    plain = v.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def added_pii(text: str):
    base, out = base_pii(text), []
    for kind in pii.ADDED:
        for m in re.finditer(pii.PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"iban": lambda: mod97(m.group()), "card15": lambda: 13 <= len(d) <= 15 and luhn(d), "ssn": lambda: True}[kind]()
            near = text[max(0, m.start() - pii.WINDOW) : m.end() + pii.WINDOW]
            score = min(1.0, pii.SCORE[kind] + pii.CONTEXT_BONUS * bool(re.search("(?i)" + pii.WORDS[kind], near)))
            if ok and score >= pii.THRESHOLD and not any(s < m.end() and m.start() < e for _, s, e in base):
                out.append((kind, m.start(), m.end()))
    return out


def test_all_pii_spans(spark, texts, folder):
    got = {r.doc_id: r.spans for r in pii.op5_pii(spark, folder).collect()}
    for i, t in texts:
        want = base_pii(t or "") + added_pii(t or "")
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in want), i


def scores_of(text: str):
    """The score of every span, by the words around it."""
    out = []
    for kind, s, e in base_pii(text) + added_pii(text):
        near = text[max(0, s - pii.WINDOW) : e + pii.WINDOW]
        out.append(round(min(1.0, pii.SCORE[kind] + pii.CONTEXT_BONUS * bool(re.search("(?i)" + pii.WORDS[kind], near))), 2))
    return out


def test_scores_by_context(spark, texts, folder):
    got = {r.doc_id: [float(x) for x in r.scores.split(",") if x] for r in pii.op5_pii(spark, folder).collect()}
    assert all(got[i] == pytest.approx(scores_of(t or "")) for i, t in texts)


def battery(token: str):
    """(bin or None, length class) of a token."""
    body = token.rstrip("=")
    alphabet = next((a for p, a in secrets_scan.ENCODINGS if re.search(p, body)), secrets_scan.WIDEST)
    at, m, n = [alphabet.find(c) for c in body], len(alphabet), len(body)
    counts = Counter(c for c in body if c in alphabet)
    square = sum(v * v for v in counts.values()) + (n - sum(counts.values())) ** 2
    chi, mean = square * m / n - n, sum(at) / n
    up = [i >= m / 2 for i in at]
    n1 = sum(up)
    n2, runs = n - n1, 1 + sum(a != b for a, b in zip(up, up[1:]))
    var = sum((i - mean) ** 2 for i in at)
    cov = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:]))
    shift = max(secrets_scan.LANGUAGE_IC * m - 1, 0.1)
    z = (chi - (m - 1) - n * shift) / math.sqrt(2 * (m - 1 + 2 * n * shift))
    mu = 2 * n1 * n2 / n + 1
    z_runs = 99.0 if n1 * n2 == 0 else (runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))
    z_serial = 99.0 if var == 0 else cov / var * math.sqrt(n)
    cls = min(5, int(math.log2(n / secrets_scan.MIN_LEN)))
    if abs(z_runs) > secrets_scan.Z_LIMIT or abs(z_serial) > secrets_scan.Z_LIMIT:
        return None, cls
    p = math.erfc(-z / math.sqrt(2)) / 2  # exact; the query's closed form is within 0.3%
    return min(secrets_scan.BINS, max(0, math.floor(-10 * math.log10(max(p, 1e-300))))), cls


def test_all_secret_spans(spark, texts, folder):
    found = {r.doc_id: r.spans for r in secrets_scan.op8_secrets(spark, folder).collect()}
    tokens, bins = {}, Counter()
    for i, t in texts:
        base = base_secrets(t or "")
        for m in re.finditer(secrets_scan.PATTERNS["random"], t or ""):
            if not any(s < m.end() and m.start() < e for _, s, e in base):
                b, cls = battery(m.group())
                tokens[i, m.start(), m.end()] = b, cls
                bins[cls, b or 0] += 1
    limit = {}
    for cls in {c for c, _ in bins}:
        total = sum(n for (c, _), n in bins.items() if c == cls)
        admitted = [b for c, b in bins if c == cls and 10 ** (-b / 10) <= secrets_scan.ALPHA * sum(n for (c2, x), n in bins.items() if c2 == cls and x >= b) / total]
        limit[cls] = min(admitted, default=999)
    assert len({b for b, _ in tokens.values()}) > 3
    for i, t in texts:
        rank = {k: j for j, k in enumerate(secrets_scan.KINDS)}
        own = base_secrets(t or "") + [("random", s, e) for (d, s, e), (b, c) in tokens.items() if d == i and b is not None and b >= limit[c]]
        assert found[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(own, key=lambda x: (x[1], rank[x[0]]))), i


def test_normal_tail(spark):
    """The closed form of the tail, to 5% down to eight deviations."""
    for x in (0.0, 0.5, 1, 2, 3, 4, 5, 6, 7, 8):
        tail = f"(-power({x}D, 2) / 2 * log10(e()) - log10(sqrt(2 * pi()) * (0.661D * {x}D + 0.339D * sqrt(power({x}D, 2) + 5.51D))))"
        got = 10 ** spark.range(1).select(F.expr(tail)).first()[0]
        assert abs(got / (math.erfc(x / math.sqrt(2)) / 2) - 1) < 0.05
    assert "0.661D" in secrets_scan._battery()


@pytest.mark.parametrize("query", [pii.op5_pii, secrets_scan.op8_secrets])
def test_many_matches_in_one_text(spark, tmp_path, query):
    text = " ".join(f"user{i}@host{i % 97}.example.org secret={i:08d}abc" for i in range(16_000))
    folder = save(table(spark, [(1, text), (2, "plain")]), tmp_path)
    query(spark, folder).collect()
    began = time.time()
    got = {r.doc_id: r.spans for r in query(spark, folder).collect()}
    assert got[1].count(",") == 15_999 and got[2] == ""
    assert time.time() - began < 15  # 75 s when every match copied what was found before


def test_very_long_runs_are_searched_whole(spark, tmp_path):
    rows = [(1, "x" * 300_000 + "@example.org"), (2, "9" * 100_000), (3, "a." * 80_000 + "b@c.de"), (4, "deadbeef" * 20_000), (5, "AKIA" + "Q" * 100_000)]
    folder = save(table(spark, rows), tmp_path)
    found = {r.doc_id: r.spans for r in pii.op5_pii(spark, folder).collect()}
    assert found[1] == "email:0:300012" and found[3] == "email:0:160006" and found[2] == ""
    found = {r.doc_id: r.spans for r in secrets_scan.op8_secrets(spark, folder).collect()}
    assert found[4] == "hex:0:160000" and found[5] == "access:0:100004"
