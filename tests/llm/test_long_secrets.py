"""Secrets on one long line."""

from __future__ import annotations

import base64
import random

from nearfold.llm import secrets_scan

from .helpers import table


def test_long_tokens_are_reported(spark):
    draw = random.Random(3)
    key = base64.b64encode(draw.randbytes(1200)).decode()
    blob = base64.urlsafe_b64encode(draw.randbytes(90_000)).decode()
    rows = table(spark, [(1, f"begin {key} end"), (2, f"x {blob}"), (3, "-" * 5_000), (4, "ABCdef012" * 300), (5, f"a {key[:100]} b")])
    out = {r.doc_id: [tuple(x) for x in r.secrets] for r in secrets_scan.secret_spans(rows).collect()}
    assert out == {1: [("random", 6, 6 + len(key))], 2: [("random", 2, 2 + len(blob))], 3: [], 4: [], 5: [("random", 2, 102)]}
