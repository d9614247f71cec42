"""Whole items in a document with a fifth of their tokens substituted, in every pattern."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from nearfold.llm import decontaminate as dc


def test_every_pattern_of_8_to_24_tokens_is_a_leak():
    for n in range(8, 25):
        item = [b"t%d" % i for i in range(n)]
        block = dc.Block([item])
        patterns = list(combinations(range(n), n // 5))
        docs = [[b"before"] + [b"x" if i in p else w for i, w in enumerate(item)] + [b"after"] for p in patterns]
        found = block.leaks(docs)
        missed = [p for p, rows in zip(patterns, found, strict=True) if not rows]
        assert not missed, (n, len(missed), len(patterns))
        assert all(r[0][1] >= min(dc.MIN_MATCH, -(-4 * n // 5)) and 5 * r[0][1] >= 4 * r[0][2] for r in found)


def test_one_substitution_more_is_none():
    for n in (8, 10, 15):
        item = [b"t%d" % i for i in range(n)]
        docs = [[b"x" if i in p else w for i, w in enumerate(item)] for p in combinations(range(n), n // 5 + 1)]
        assert not any(dc.Block([item]).leaks(docs))


def test_stretch_against_all_windows():
    rng = np.random.default_rng(4)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.75, 0.9])
        windows = [(int(same[s:e].sum()), e - s, s) for s in range(len(same)) for e in range(s + 1, len(same) + 1) if same[s] and 5 * same[s:e].sum() >= 4 * (e - s)]
        want = min(windows, key=lambda x: (-x[0], x[1], x[2]), default=(0, 0, 0))
        assert dc._stretch(same) == want
