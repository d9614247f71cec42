"""LM scoring: a causal self-attention model, trained in numpy, on subword ids.

Counts.  Words of the training documents are counted over all of them (a shuffle by word).  For the
base score the ``HEAVY`` most frequent words' counts go to the workers as one bounded broadcast;
the other words of each document, few of its tokens, are joined with the count table by shuffle, so
a word in every document is never shuffled and no whole vocabulary is broadcast.

Model.  Each word, with a space before it, is encoded by a public byte-level tokenizer (its folder is
a parameter; the file goes to the workers as a broadcast).  Subword ids are counted over all training
documents.  One layer of causal self-attention over ``CONTEXT + STRIDE`` positions, with an embedding
for every subword that occurs and a learnt bias per distance, predicts the next subword by an
adaptive softmax: the ``HEAD`` most frequent subwords and ``TAILS`` clusters of the others share one
softmax, and within a cluster a softmax over its subwords, from the same context, settles which.
Subwords that never occur share one place evenly.  So probabilities sum to one over subword
sequences, ended by one end token.  Untrained, the model is the unigram of the counts.

Reading.  When words are counted, every text is read once, many texts at a time: words get numbers, new ones are encoded in one call, and
items, base scores and other words follow from tables by number.  Training and scoring go on from the staged items.

Training.  Every training document is cut whole into windows of ``SPAN`` positions, so each of its subwords
is learnt from once.  Runs of ``RUN`` windows fall, by a hash of their items, their place and the doc_id, into ``ROUNDS``
rounds and, within a round, into parts of about ``TASK_WINDOWS``.  In each round a task runs Adam over each part,
from the same model, and the models are averaged by windows seen (chunk by chunk, in a shuffle).  So a
corpus of any size is gone through once, in parallel.  Rounds, parts, their order and the order of
the sums follow from doc_id and text alone, so neither partitions nor retries change the model.

Scoring.  A document is cut into windows that overlap by ``CONTEXT`` positions: each token is scored
once, in the window where it stands behind that context, and windows of many documents go through
masked attention together.

Defined cases: a null or empty text is its end token alone; rows that repeat a doc_id are scored
each, and those that repeat its text too are learnt from in one part (copies under other ids, in any);
a null doc_id is learnt from and not held out; without training documents counts are zero,
N = V = 0, and the model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from copy import deepcopy
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, staged, text_bytes

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Word pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SUBWORDS = 50_256
HEAVY = 200_000
HEAD, TAILS = 83, 28  # with the end 112 classes: a multiple of the processor's vector width
WIDTH, CONTEXT, STRIDE = 16, 8, 24
SPAN = CONTEXT + STRIDE
ROUNDS, TASK_WINDOWS = 4, 16_000
BATCH, RATE = 128, 0.01
RUN = 16  # windows of a text that are dealt together
MEMO = 200_000  # words beside the frequent ones that a process holds
PAD = 65_535


# --- subwords -------------------------------------------------------------------------------


_made: dict[str, object] = {}  # tokenizers by the digest of their file; made once in a process


def encoder(vocabulary: tuple[str, bytes]):
    """The tokenizer of a vocabulary: the digest of its file, and the file."""
    name, file = vocabulary
    if name not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        _made[name] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[name]


def read_vocabulary(folder: str = TOKENIZERS) -> tuple[str, bytes]:
    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        file = f.read()
    return xxhash.xxh3_128_hexdigest(file), file


def subwords(word: bytes, vocabulary: tuple[str, bytes]) -> list[int]:
    return encoder(vocabulary).encode_ordinary(" " + word.decode("utf-8", "replace"))


def subwords_of(words: list[bytes], vocabulary: tuple[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words in a row, and how many each word has: those of ``subwords``, in one call.

    No piece of the pattern goes beyond a space before it, so words joined by spaces fall into the same subwords as
    each by itself, and those that begin with a space begin a word.  Words that are no UTF-8 or hold other white space go one by one.
    """
    made = encoder(vocabulary)
    try:
        text = " " + b" ".join(words).decode()
    except UnicodeDecodeError:
        text = ""
    if words and text and sum(map(len, text.split())) + len(words) == len(text):
        begins = _made.get(vocabulary[0] + " ")
        if begins is None:
            begins = _made[vocabulary[0] + " "] = np.array([made.decode_single_token_bytes(i)[:1] == b" " for i in range(SUBWORDS)])
        ids = made.encode_to_numpy(text, disallowed_special=())
        at = np.flatnonzero(begins[ids])
        if len(at) == len(words):
            return ids, np.diff(np.r_[at, len(ids)])
    each = [subwords(w, vocabulary) for w in words]
    return np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))


# --- model ----------------------------------------------------------------------------------


class Attention:
    """One causal self-attention layer over items: subwords by frequency, one for all that never occur, and
    the end, which also stands before the text."""

    def __init__(self, counts: np.ndarray, width: int = WIDTH, seed: int = 3) -> None:
        """counts: of each subword id in the training documents."""
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        seen = order[counts[order] > 0]
        n = len(seen)
        self.end, self.never = n + 1, len(counts) - n
        self.item = np.full(len(counts), n, np.uint16)  # of each subword id
        self.item[seen] = np.arange(n)
        own = min(HEAD, n)
        mass = np.r_[counts[seen] + 0.5, max(0.5 * self.never, 0.5)]
        rest = np.cumsum(mass[own:])
        cluster = np.minimum((rest / rest[-1] * TAILS).astype(np.int64), TAILS - 1)
        self.own, self.classes = own, own + TAILS + 1
        self.cls = np.r_[np.arange(own), own + cluster, self.classes - 1]
        self.bounds = own + np.searchsorted(cluster, np.arange(TAILS + 1))  # items of each cluster
        total = np.bincount(self.cls[:-1], mass, self.classes)
        total[-1] = max(1.0, mass.sum() / 500)
        g = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "emb": g(n + 2, width) * 5, "q": g(width, width), "k": g(width, width), "v": g(width, width), "far": np.zeros(SPAN, np.float32),
            "out": np.zeros((width, self.classes), np.float32), "bias": np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32),
            "tail": np.zeros((n + 2, width), np.float32), "tail_bias": np.log(np.r_[mass, 1.0]).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        """All parameters as one array."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def take(self, flat: np.ndarray) -> Attention:
        """Sets all parameters from one array."""
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size
        return self

    def hidden(self, ids: np.ndarray):
        """What stands for every position of each row, and what led to it."""
        p, n = self.p, ids.shape[1]
        x = p["emb"][ids]
        q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
        lag = np.arange(n)[:, None] - np.arange(n)[None, :]
        score = q @ k.transpose(0, 2, 1) / np.float32(np.sqrt(p["q"].shape[1]))
        score += np.where(lag >= 0, p["far"][np.maximum(lag, 0)], np.float32(-1e9))
        score -= score.max(2, keepdims=True)
        a = np.exp(score)
        a /= a.sum(2, keepdims=True)
        return x + a @ v, (x, q, k, v, a, lag)

    def by_cluster(self, cls: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(items of the cluster, places) for each cluster among the classes."""
        at = np.flatnonzero((cls >= self.own) & (cls < self.classes - 1))
        at = at[np.argsort(cls[at], kind="stable")]
        cuts = np.searchsorted(cls[at], np.arange(self.own, self.classes))
        for c in np.flatnonzero(np.diff(cuts)):
            yield slice(int(self.bounds[c]), int(self.bounds[c + 1])), at[cuts[c] : cuts[c + 1]]

    def plain(self, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of the target items at all positions; the plain form of ``log_probability``."""
        h = self.hidden(ids)[0].reshape(-1, self.p["q"].shape[1]).astype(np.float64)
        logits = h @ self.p["out"] + self.p["bias"]
        goal = target.ravel()
        cls = self.cls[goal]
        out = logits[np.arange(len(goal)), cls] - np.log(np.exp(logits).sum(1))
        for items, at in self.by_cluster(cls):
            inner = h[at] @ self.p["tail"][items].T + self.p["tail_bias"][items]
            out[at] += inner[np.arange(len(at)), goal[at] - items.start] - np.log(np.exp(inner).sum(1))
        return out.reshape(target.shape)

    def prepare(self) -> Attention:
        """Tables by item for scoring windows of ``SPAN`` positions."""
        p = self.p
        one = np.ones((len(p["emb"]), 1), np.float32)
        query, key = (p["emb"] @ p["q"]) / np.float32(np.sqrt(p["q"].shape[1])), p["emb"] @ p["k"]
        self.asks = query @ p["k"].T  # times an item's embedding: query times key
        lag = np.arange(SPAN)[CONTEXT:, None] - np.arange(SPAN)[None, :]
        most = np.sqrt((query**2).sum(1).max() * (key**2).sum(1).max()) + p["far"].max()  # taken off, so no exponent is above 0
        self.reach = np.where(lag >= 0, p["far"][np.maximum(lag, 0)] - np.minimum(most, 60), -np.inf).astype(np.float32)
        self.owned = np.concatenate([p["emb"], one], 1)  # the last column adds up the weights
        self.head = np.concatenate([p["out"], p["bias"][None]]).astype(np.float32)
        self.tails = np.concatenate([p["tail"], p["tail_bias"][:, None]], 1).T.astype(np.float32)
        return self

    def log_probability(self, ids: np.ndarray, first: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of the target's class at the last ``STRIDE`` positions of each window, flat,
        and what stands for these positions.

        ``first`` marks windows that begin a text: their context is masked.  Few windows at a time
        keep all arrays in the processor's cache.
        """
        ids = ids.astype(np.intp)
        n = len(ids) * STRIDE
        x = self.owned.take(ids, 0)
        a = self.asks.take(ids[:, CONTEXT:], 0) @ x[..., :-1].transpose(0, 2, 1)
        a += self.reach
        a[first, :, :CONTEXT] = -np.inf
        np.exp(a, out=a)
        mixed = (a @ x).reshape(n, -1)
        mixed /= np.maximum(mixed[:, -1:], np.float32(1e-30))
        h = x[:, CONTEXT:].reshape(n, -1)
        h[:, :-1] += mixed[:, :-1] @ self.p["v"]
        logits = h @ self.head
        if logits.max(initial=0) > 80:
            logits -= logits.max(1, keepdims=True)
        picked = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + cls]
        np.exp(logits, out=logits)
        return picked - np.log(logits @ np.ones(logits.shape[1], np.float32)), h

    def within(self, h: np.ndarray, item: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log-probability of the items within their clusters."""
        out = np.zeros(len(item))
        for items, at in self.by_cluster(cls):
            tail, ones = self.tails[:, items], np.ones(items.stop - items.start, np.float32)
            block = max(64, 65_536 // len(ones))
            for lo in range(0, len(at), block):
                some = at[lo : lo + block]
                inner = h.take(some, 0) @ tail
                if inner.max(initial=0) > 60:
                    inner -= inner.max(1, keepdims=True)
                picked = inner.ravel()[np.arange(0, inner.size, len(ones)) + (item[some] - items.start)]
                np.exp(inner, out=inner)
                out[some] = picked - np.log(np.maximum(inner @ ones, np.float32(1e-30)))
        return out

    def groups(self, most: int = 128) -> tuple[list[tuple[int, slice, np.ndarray | None]], list[int]]:
        """Neighbouring clusters that have up to ``most`` items together, so that they go through one product: (first
        cluster, items, what is added to a row by its cluster so that only that cluster's items count); and where groups begin."""
        out, begin, lo = [], [], 0
        while lo < TAILS:
            hi = lo + 1
            while hi < TAILS and self.bounds[hi + 1] - self.bounds[lo] <= most:
                hi += 1
            of = np.repeat(np.arange(hi - lo), np.diff(self.bounds[lo : hi + 1]))
            only = np.where(of == np.arange(hi - lo)[:, None], np.float32(0), np.float32(-np.inf)) if hi > lo + 1 else None
            out.append((lo, slice(int(self.bounds[lo]), int(self.bounds[hi])), only))
            begin.append(lo)
            lo = hi
        return out, [*begin, TAILS]

    def fit(self, windows: np.ndarray, passes: int = 1, batch: int = BATCH, rate: float = RATE, seed: int | tuple[int, ...] = 5) -> Attention:
        """Adam over windows of ``SPAN`` + 1 items each (``PAD`` behind the end).

        All parameters and their gradients are parts of one array each.  ``x1``, ``h1`` and ``d1`` carry one more
        column, so that one product gives a sum or takes a mean off too; weights of attention and softmax stay
        undivided and their sums divide the narrower arrays.  Large arrays are made once.
        """
        rng, width, classes = np.random.default_rng(seed), self.p["q"].shape[1], self.classes
        step, every = 0, self.flat()
        slope, first, second, room = (np.zeros_like(every) for _ in range(4))
        p, grad, at = {}, {}, 0
        for k in sorted(self.p):
            shape, size = self.p[k].shape, self.p[k].size
            p[k], grad[k] = every[at : at + size].reshape(shape), slope[at : at + size].reshape(shape)
            at += size
        self.p = p
        scale, top = np.float32(1 / np.sqrt(width)), np.float32(60)
        lag = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
        ahead, lag = lag < 0, np.maximum(lag, 0)
        groups, begin = self.groups()
        ones = np.ones(max(classes, len(p["tail"])), np.float32)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        made = lambda *s: np.empty((min(batch, len(windows)), *s), np.float32)
        x1_, turned_, e_, ds_, h1_, d1_, dh_ = made(SPAN, width + 1), made(width + 1, SPAN), made(SPAN, SPAN), made(SPAN, SPAN), made(SPAN, width + 1), made(SPAN, width + 1), made(SPAN, width)
        x1_[..., -1] = h1_[..., -1] = turned_[:, -1] = 1
        block = 512  # positions whose classes stay in the cache
        d_, place = np.empty((block, classes), np.float32), np.arange(block) * classes
        for rows in (rng.permutation(len(windows))[at : at + batch] for _ in range(passes) for at in range(0, len(windows), batch)):
            step += 1
            own, b = windows[rows].astype(np.intp), len(rows)
            n = b * SPAN
            ids = np.where(own[:, :-1] == PAD, self.end, own[:, :-1])
            live = (own[:, 1:] != PAD).ravel()
            goal = np.where(live, own[:, 1:].ravel(), self.end)
            cls = self.cls[goal]
            share = np.float32(1 / max(1, live.sum()))
            # attention
            x1, turned, e, ds, h1, d1, dh = x1_[:b], turned_[:b], e_[:b], ds_[:b], flat(h1_[:b]), d1_[:b], flat(dh_[:b])
            x = p["emb"].take(ids, 0)
            x1[..., :-1] = x
            turned[:, :-1] = x.transpose(0, 2, 1)
            xs, both = flat(x), p["q"] @ p["k"].T * scale
            y = (xs @ both).reshape(x.shape)
            np.matmul(y, turned[:, :-1], out=e)
            e += np.where(ahead, np.float32(-np.inf), p["far"][lag])
            if e.max(initial=0) > top or np.einsum("bii->bi", e).min(initial=0) < -top:
                e -= e.max(2, keepdims=True)
            np.exp(e, out=e)
            z1 = flat(e @ x1)
            over = 1 / z1[:, -1:]
            z = z1[:, :-1] * over
            np.add(xs, z @ p["v"], out=h1[:, :-1])
            # head
            head, back = np.concatenate([p["out"], p["bias"][None]]), np.ascontiguousarray(p["out"].T)
            dhead = np.zeros_like(head)
            for lo in range(0, n, block):
                s = slice(lo, min(lo + block, n))
                d = d_[: s.stop - lo]
                np.matmul(h1[s], head, out=d)
                goals = place[: len(d)] + cls[s]
                if d.max() > top or d.ravel()[goals].min() < -top:
                    d -= d.max(1, keepdims=True)
                np.exp(d, out=d)
                total = d @ ones[:classes]
                d.ravel()[goals] -= total
                part = (live[s] * share / total)[:, None]
                np.multiply(d @ back, part, out=dh[s])
                dhead += (h1[s] * part).T @ d
            grad["out"][...], grad["bias"][...] = dhead[:-1], dhead[-1]
            # tails
            at = np.flatnonzero(live & (cls >= self.own) & (cls < classes - 1))
            at = at[np.argsort(cls[at].astype(np.uint16), kind="stable")]
            h2, item, cluster = h1.take(at, 0), goal[at], cls[at] - self.own
            dh2, cuts = np.empty((len(at), width), np.float32), np.searchsorted(cluster, begin)
            for (c, items, only), lo, hi in zip(groups, cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    grad["tail"][items] = grad["tail_bias"][items] = 0
                    continue
                s, tail = slice(lo, hi), p["tail"][items]
                d = h2[s, :-1] @ tail.T
                d += p["tail_bias"][items] if only is None else (only + p["tail_bias"][items]).take(cluster[s] - c, 0)
                goals = np.arange(0, d.size, d.shape[1]) + (item[s] - items.start)
                if d.max() > top or d.ravel()[goals].min() < -top:
                    d -= d.max(1, keepdims=True)
                np.exp(d, out=d)
                total = d @ ones[: d.shape[1]]
                d.ravel()[goals] -= total
                part = share / total
                dtail = d.T @ (h2[s] * part[:, None])
                grad["tail"][items], grad["tail_bias"][items] = dtail[:, :-1], dtail[:, -1]
                np.multiply(d @ tail, part[:, None], out=dh2[s])
            dh[at] += dh2
            # attention, back
            dz, d1 = dh @ p["v"].T, flat(d1)
            np.multiply(dz, over, out=d1[:, :-1])
            np.multiply(np.einsum("ij,ij->i", dz, z), -over[:, 0], out=d1[:, -1])
            d1 = d1.reshape(x1.shape)
            np.matmul(d1, turned, out=ds)
            ds *= e
            grad["far"][...] = np.bincount(lag.ravel(), ds.sum(0).ravel(), SPAN)
            dy = flat(ds @ x)
            dboth = xs.T @ dy
            grad["q"][...], grad["k"][...], grad["v"][...] = dboth @ p["k"] * scale, dboth.T @ p["q"] * scale, z.T @ dh
            dh += dy @ both.T
            dh += flat(ds.transpose(0, 2, 1) @ y)
            dh += flat(e.transpose(0, 2, 1) @ d1[..., :-1])
            grad["emb"].ravel()[...] = np.bincount((ids.ravel()[:, None] * width + np.arange(width)).ravel(), dh.ravel(), p["emb"].size)
            # step, a piece of all parameters at a time
            fade = np.sqrt(1 - 0.99**step)
            near, length = np.float32(1e-7 * fade), np.float32(rate * fade / (1 - 0.9**step))  # the moments are kept without their 0.1 and 0.01
            for lo in range(0, len(every), 32_768):
                s = slice(lo, lo + 32_768)
                g, f, v, r = slope[s], first[s], second[s], room[s]
                f *= np.float32(0.9)
                f += g
                v *= np.float32(0.99)
                v += np.multiply(g, g, out=r)
                np.sqrt(v, out=r)
                r += near
                np.divide(f, r, out=r)
                r *= length
                every[s] -= r
        return self


class LanguageModel:
    """The attention with its tokenizer, and the base score's table of frequent words."""

    def __init__(self, counts: np.ndarray, vocabulary: tuple[str, bytes]) -> None:
        """counts: of each subword id in the training documents."""
        self.vocabulary = vocabulary
        self.net = Attention(counts).prepare()
        self.end = self.net.end
        even = -float(np.log(max(1, self.net.never)))  # of one subword among those that never occur
        self._log = np.where(self.net.item == self.end - 1, even, 0.0)
        self.often: list[bytes] = []  # the frequent words
        self.base = np.zeros(0)  # and their base scores
        self._code: dict[bytes, int] | None = None  # of every word met, the frequent ones first; made in each process

    def _codes(self, words: list[bytes]) -> np.ndarray:
        """A number for each word; the tables by number hold it.  Words that are not frequent are forgotten when they are ``MEMO``."""
        if self._code is None or len(self._code) > len(self.often) + MEMO:
            self._code = defaultdict()
            self._code.default_factory = self._code.__len__
            self._code.update(zip(self.often, range(len(self.often))))
            if len(self._code) != len(self.often):
                raise ValueError("a frequent word is given twice")
            if not hasattr(self, "_held"):
                self._held = self._tables(self.often)
            self._words, (self._size, self._log_of, self._pool) = list(self.often), self._held
            self._begin = np.cumsum(self._size) - self._size
        code = self._code
        old = len(code)
        out = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        if len(code) > old:
            new = list(islice(reversed(code), len(code) - old))[::-1]
            size, log, pool = self._tables(new)
            self._words += new
            self._begin = np.concatenate([self._begin, np.cumsum(size) - size + len(self._pool)])
            self._size, self._log_of, self._pool = np.concatenate([self._size, size]), np.concatenate([self._log_of, log]), np.concatenate([self._pool, pool])
        return out

    def _tables(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: how many items, the log-probability of those among the ones that never occur; and all items in a row."""
        ids, size = subwords_of(words, self.vocabulary)
        ids = ids.astype(np.int64)
        return size, np.bincount(np.repeat(np.arange(len(words)), size), self._log[ids], len(words)), self.net.item[ids]

    def word(self, word: bytes) -> tuple[bytes, float]:
        """Items of a word's subwords, two bytes each, and the log-probability of those among the ones that never occur."""
        _, log, items = self._tables([word])
        return items.tobytes(), float(log[0])

    def read_all(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of texts, given as their words: all items in a row and where each text's end, the log-probability beside
        them; base score and number of the frequent words' tokens; text, count and word for each other word of a text."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        code, text = self._codes(list(chain.from_iterable(texts))), np.repeat(np.arange(len(texts)), n)
        size = self._size[code]
        ends = np.cumsum(size)
        items = self._pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._begin[code] - ends + size, size)]
        log = np.bincount(text, self._log_of[code], len(texts))
        often = code < len(self.often)
        base = np.bincount(text[often], self.base[code[often]], len(texts))
        seen = np.bincount(text[often], minlength=len(texts))
        pairs, times = np.unique(text[~often] * len(self._words) + code[~often], return_counts=True)
        rest = [self._words[c] for c in (pairs % max(1, len(self._words))).tolist()]
        return items, np.r_[0, ends][np.cumsum(n)], log, base, seen, pairs // max(1, len(self._words)), times, rest

    def read(self, words: list[bytes]) -> tuple[bytes, float, float, int, list[bytes], list[int]]:
        """Of one text: its items, the log-probability beside them; base score and number of the frequent
        words' tokens; the other words and their counts."""
        items, _, log, base, seen, _, times, rest = self.read_all([words])
        return items.tobytes(), float(log[0]), float(base[0]), int(seen[0]), rest, times.tolist()

    def scores(self, encoded: list[tuple[bytes, float]], rows: int = 48, most: int = 200_000) -> np.ndarray:
        """log10-probability of each text, given as its items and the log-probability beside them."""
        total = np.array([x for _, x in encoded], float)
        n = np.array([len(c) // 2 + 1 for c, _ in encoded], np.int64)  # positions: the end before, then subwords
        windows = -(-n // STRIDE)
        begin = np.cumsum(windows * STRIDE) - windows * STRIDE
        size = int((windows * STRIDE).sum())
        # each text fills whole strides; `ids` are inputs, `target` what follows them
        ids, target, live = np.full(size, self.end, np.uint16), np.full(size, self.end, np.uint16), np.zeros(size, bool)
        for (c, _), b, k in zip(encoded, begin, n, strict=True):
            own = np.frombuffer(c, np.uint16)
            ids[b + 1 : b + k] = own
            target[b : b + k - 1] = own
            live[b : b + k] = True
        count = size // STRIDE
        owner = np.repeat(np.arange(len(encoded)), windows * STRIDE)
        first = np.zeros(count, bool)
        first[(begin // STRIDE).astype(np.int64)] = True
        spans, classes = ids.reshape(-1, STRIDE), self.net.cls[target]
        inner = live & (classes >= self.net.own) & (classes < self.net.classes - 1)
        before = np.concatenate([np.full((1, STRIDE), self.end, np.uint16), spans[:-1]])[:, STRIDE - CONTEXT :] if count else spans[:, :CONTEXT]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            at, h = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            np.add(total, np.bincount(owner[at], self.net.within(h, target[at].astype(np.int64), classes[at]), len(encoded)), out=total)

        waiting = 0
        for at in range(0, count, rows):
            s, t = slice(at, at + rows), slice(at * STRIDE, (at + rows) * STRIDE)
            lp, h = self.net.log_probability(np.concatenate([before[s], spans[s]], 1), first[s], classes[t])
            total += np.bincount(owner[t], np.where(live[t], lp, 0), len(encoded))
            place = np.flatnonzero(inner[t])
            held.append((place + at * STRIDE, h.take(place, 0)))
            waiting += len(place)
            if waiting > most:
                settle()
                waiting = 0
        if held:
            settle()
        return total / np.log(10)

    def windows(self, text: bytes) -> np.ndarray:
        """The whole text as windows of training."""
        return cut_windows(self.read(text.lower().split())[0], self.end)


def cut_windows(items: bytes, end: int) -> np.ndarray:
    """A text's items as rows of ``SPAN`` + 1 items: what stands before each position, and the last target.

    The end stands before the text and behind it; ``PAD`` fills the last row.
    """
    return windows_of(flow_of(items, end))


def flow_of(items: bytes, end: int) -> np.ndarray:
    """The items between two ends, and ``PAD`` up to a whole number of windows."""
    n = len(items) // 2 + 2
    full = np.full(-(-(n - 1) // SPAN) * SPAN + 1, PAD, np.uint16)
    full[0] = full[n - 1] = end
    full[1 : n - 1] = np.frombuffer(items, np.uint16)
    return full


def windows_of(flow: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(flow, SPAN + 1)[::SPAN]


# --- counts ---------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over the column ``t``, binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.lower().split())
                if len(held) > 400_000:
                    yield _pairs(held)
                    held = Counter()
        yield _pairs(held)

    return texts.select("t").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def subword_counts(counts: DataFrame, vocabulary: tuple[str, bytes]) -> np.ndarray:
    """Occurrences of every subword id, from the table of word counts."""
    file = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SUBWORDS, np.int64)
        for batch in batches:
            ids, size = subwords_of(batch.column(0).to_pylist(), file.value)
            held += np.bincount(ids.astype(np.int64), np.repeat(batch.column(1).to_numpy(), size), SUBWORDS).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["id", "n"])

    rows = counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row per subword id at most
    out = np.zeros(SUBWORDS, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def heavy_words(counts: DataFrame, most: int = HEAVY) -> dict[bytes, int]:
    """Up to ``most`` words, all those above a count that keeps them that few."""
    step = F.floor(F.log2("n") * 8).cast("int")
    hist = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect()  # about 8 rows per doubling
    total, limit = 0, None
    for r in hist:
        total += r.k
        if total > most:
            break
        limit = r.step
    if limit is None:
        return {}
    rows = counts.filter(step >= limit).toPandas()
    return dict(zip(map(bytes, rows["word"]), rows["n"].tolist(), strict=True))


def read_texts(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, n_tokens, items, log, base, known, tail, times, row) of rows (doc_id, held_out, t): every text read once, for training and scores."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.lower().split() for t in part.column(2).to_pylist()]
                items, ends, log, base, known, owner, times, rest = held.value.read_all(texts)
                begin = np.r_[0, ends] * items.itemsize
                if begin[-1] > 2**31 - 1:
                    raise ValueError("texts of one batch have over a billion subwords")
                cuts = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                columns = [
                    part.column(0), part.column(1), pa.array([len(w) + 1 for w in texts], pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(items)]), pa.array(log.astype(float)), pa.array(base.astype(float)), pa.array(known, pa.int64()),
                    pa.ListArray.from_arrays(cuts, pa.array(rest, pa.binary())), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "items", "log", "base", "known", "tail", "times"])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, items binary, log double, base double, known long, tail array<binary>, times array<long>")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "read")


def _averaged(models: DataFrame) -> np.ndarray:
    """The mean by ``n`` of arrays dealt in chunks: rows (chunk, part, n, w).  Sums go in order of the parts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = sum(np.frombuffer(w, np.float64) for w in pdf["w"])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [pdf["n"].sum()], "w": [total.tobytes()]})

    kind = "chunk int, part long, n double, w binary"
    some = models.groupBy("chunk", F.pmod("part", F.lit(64))).applyInPandas(lambda pdf: add(pdf), kind)
    rows = some.groupBy("chunk").applyInPandas(lambda pdf: add(pdf), kind).toPandas().sort_values("chunk")  # one model
    return np.concatenate([np.frombuffer(w, np.float64) / n for w, n in zip(rows["w"], rows["n"], strict=True)]) if len(rows) else np.zeros(0)


def _trainer(held: Broadcast, r: int):
    """What trains a part of a round: its windows, sorted and dealt into batches by round and part."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        rows = np.concatenate([windows_of(np.frombuffer(w, np.uint16)) for w in sorted(own["w"].to_pylist())])
        part, n = key[0].as_py(), len(rows)
        flat = deepcopy(held.value).fit(rows, rate=RATE * (1 - r / (ROUNDS + 1)), seed=(r, part)).flat().astype(np.float64) * n
        parts = [flat[at : at + 8_192].tobytes() for at in range(0, len(flat), 8_192)]
        return pa.Table.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int64()), pa.array([float(n)] * len(parts)), pa.array(parts, pa.binary())], ["chunk", "part", "n", "w"])

    return run


def _dealer(r: int, parts: int, end: int):
    """What picks the runs of a round from rows (doc_id, items) and deals them: rows (part, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, picked = [], []
            for i, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flow, seed = flow_of(items, end), xxhash.xxh3_64_intdigest(str(i).encode())
                for at in range(0, len(flow) - 1, RUN * SPAN):
                    w = flow[at : at + RUN * SPAN + 1].tobytes()
                    h = xxhash.xxh3_64_intdigest(w, seed ^ at)
                    if h % ROUNDS == r:
                        to.append((h >> 8) % parts)
                        picked.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(picked, pa.binary())], ["part", "w"])

    return run


def train(texts: DataFrame, model: LanguageModel) -> None:
    """Rounds of Adam in tasks over every window of rows (doc_id, items), the models of a round averaged."""
    context = texts.sparkSession.sparkContext
    total = texts.agg(F.coalesce(F.sum(F.ceil((F.length("items") / 2 + 1) / SPAN)), F.lit(0))).first()[0]
    parts = max(1, -(-total // (ROUNDS * TASK_WINDOWS)))
    for r in range(ROUNDS):
        held = context.broadcast(model.net)
        dealt = texts.mapInArrow(_dealer(r, parts, model.end), "part long, w binary")
        mean = _averaged(dealt.groupBy("part").applyInArrow(_trainer(held, r), "chunk int, part long, n double, w binary"))
        if len(mean):
            model.net.take(mean)
        held.destroy()
    model.net.prepare()


def score(docs: DataFrame, held_out: Column, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), text_bytes().alias("t"))
    learn = rows.filter(~F.col("held_out"))
    counts = staged(word_counts(learn), "counts")
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learn.count()
    big_n, big_v = n_words + ends, distinct + (ends > 0)
    vocabulary = read_vocabulary(folder)
    model = LanguageModel(subword_counts(counts, vocabulary), vocabulary)
    below = float(np.log10(big_n + big_v + 1))
    often_seen = heavy_words(counts)
    model.often, model.base = list(often_seen), np.log10(np.fromiter(often_seen.values(), np.float64, len(often_seen)) + 1) - below
    read = read_texts(rows, model)
    train(read.filter(~F.col("held_out")).select("doc_id", "items"), model)
    held = spark.sparkContext.broadcast(model)
    end_log = float(np.log10(ends + 1)) - below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = held.value.scores(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), *part.columns[3:]], ["row", "score", *names])

    names = ["doc_id", "held_out", "n_tokens", "base", "known"]
    kinds = dict(read.dtypes)
    scored = read.select("row", "items", "log", *names).mapInArrow(run, ", ".join(["row long", "score double", *(f"{c} {kinds[c]}" for c in names)]))
    scored = staged(scored, "scored")  # narrow: no texts any more
    tail = read.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("c"))
    tail = tail.join(counts, "word", "left")
    part = F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(float(below))
    sums = tail.groupBy("row").agg(F.sum(F.col("c") * part).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("seen"))
    out = scored.join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(big_n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end_log) + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score(documents(spark, sf_dir).select("doc_id", "text"), fold(7, 2))


QUERIES = {"op6_lm_score": op6_lm_score}
#: A fitted model; tests hold counts and base score against Python and the score against a plain forward pass.
ORACLE_SQL: dict[str, str] = {}
