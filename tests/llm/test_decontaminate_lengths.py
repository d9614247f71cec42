"""Items of every length, repeated tokens, long texts."""

from __future__ import annotations

import numpy as np

from nearfold.llm import decontaminate as dc


def test_recall_by_length():
    """Whole items with as many substitutions as the rule allows, at random places, all found."""
    rng = np.random.default_rng(3)
    for n in range(1, 31):
        item = [b"t%d" % i for i in range(n)]
        block = dc.Block([item])
        allowed = 0 if n < dc.WHOLE else n // 5
        docs = []
        for _ in range(60):
            own = list(item)
            for p in rng.choice(n, allowed, replace=False):
                own[p] = b"x"
            docs.append([b"a"] * 5 + own + [b"b"] * 5)
        found = [bool(r) for r in block.leaks(docs)]
        assert all(found) if n >= dc.MIN_ITEM else not any(found), n


def test_short_items_leak_only_word_for_word():
    for n in range(dc.MIN_ITEM, dc.WHOLE):
        item = [b"t%d" % i for i in range(n)]
        one_off = [[b"x" if i == p else w for i, w in enumerate(item)] for p in range(n)]
        assert not any(dc.Block([item]).leaks(one_off)) and dc.Block([item]).leaks([[b"a", *item, b"b"]]) == [[(0, n, n, 1)]]


def test_repeated_tokens_stay_bounded():
    item, text = [b"la"] * 40, [b"la"] * 60_000
    assert dc.Block([item, [b"la"] * 6]).leaks([text, [b"so"] * 100]) == [[(0, 40, 40, 0), (1, 6, 6, 0)], []]
