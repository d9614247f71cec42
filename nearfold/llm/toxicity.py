"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learnt from a bounded sample: up to ``EXAMPLES`` labelled rows (least hash of doc_id) with ``POSTINGS`` terms
together, of which those
with the same words in the same order and the same label count once, are the examples.  Terms are
words and, of words longer than ``STEM`` bytes, their first ``STEM`` bytes, so inflected forms share
a term.  All terms of the examples are indexed.  Document frequencies are counted over all documents.
A vector holds (1 + ln tf) * idf * a(term), normalised, where ``a`` grows with the term's association
with the label (log-likelihood ratio among the examples) and is never below ``FLOOR``: terms that tell
nothing about the label count little, but none is left out.  Terms that no example has can't match
and are no part of a vector.

The index is an inverted one: postings by term over the examples, ordered so that like examples stand
together.  Tasks weigh the vectors, deal the postings by term and sort them; the driver gets the lists
ready made.  Terms that more than ``SHARES`` of the examples hold fall into groups, the commonest last,
and have the largest weight of every block of ``BLOCK`` examples beside them.  A query sums the lists of its
rarer terms.  What the groups that are left can still give an example is bounded by their block maxima
and, by Cauchy and Schwarz, by the norms of query and example within each group, whichever is less.
The ``LEAD`` examples of the highest bounds are scored in full, which gives a limit that no example below
it can pass; only those whose bound reaches it stay.  The next group's lists are summed only for queries with more
than ``FEW`` examples left, then bounds and limit are drawn again; the few that stay are scored in full.
So most postings of common terms are never looked at (``test_most_postings_are_skipped``).  Bounds allow for
their rounding and scores are summed in double precision, so the K nearest are exact; ties
go to the lower doc_id.  Neighbours vote with weight 1 / (``SOFT`` + distance), the prior counts as
one neighbour, and a logistic curve fitted on the examples, each without itself, makes votes scores;
those votes are taken in tasks.  Documents without any term of the examples have no neighbours: they
get the share of such examples that are toxic.  Index and model are bounded by the sample, so each
task holds them whole.

Defined cases: a null or empty text has no terms; label rows with null or other values than 0 and 1
are left out, where a doc_id has several the largest counts; of documents that repeat a labelled
doc_id the least text is learnt from; without examples every score is 0.5, the share of none with one
added to each side; repeated rows and null doc_ids are scored row by row; doc_id may be of any type;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, fold, free_name, staged, text_bytes
from .decontaminate import tokens
from .quality import examples, with_texts

EXAMPLES = 12_000  # fewer than 65,536, so that places take two bytes
POSTINGS = 8_000_000  # terms of all examples together: of longer texts fewer examples are taken
STEM = 5
FLOOR, HALF = 0.02, 18.0
K, BLOCK, TOGETHER, SOFT = 15, 64, 4, 0.05
#: Groups of common terms, by the share of the examples that hold them more often than this.
SHARES = (0.06, 0.1, 0.15, 0.22, 0.35, 0.52)
LEAD, FEW, PARTS = 60, 512, 16
CACHE = 20_000


def term(word: bytes) -> int:
    """The 63-bit hash of a term."""
    return xxhash.xxh3_64_intdigest(word) >> 1


class Words(dict):
    """Hashes of a word and its stem, which ends in ``*`` (0 if the word is no longer than that), remembered."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        own = self[word] = term(word), term(word[:STEM] + b"*") if len(word) > STEM else 0
        return own


class TermCounter:
    """Counts of terms in texts, by their place in a table of terms if given, else by their hash."""

    def __init__(self, table: np.ndarray | None = None) -> None:
        self.table, self.known = table, Words()

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms ascending, and their counts, of each text; terms are looked up for all texts at once."""
        if len(self.known) > CACHE * 5:
            self.known.clear()
        held = [Counter(tokens(t)) for t in texts]
        total = sum(map(len, held))
        hashes = np.fromiter(chain.from_iterable(map(self.known.__getitem__, chain.from_iterable(held))), np.int64, 2 * total)
        counts = np.repeat(np.fromiter(chain.from_iterable(c.values() for c in held), np.int64, total), 2)
        owner = np.repeat(np.arange(len(texts)), [2 * len(c) for c in held])
        on = hashes != 0
        hashes, counts, owner = hashes[on], counts[on], owner[on]
        names, which = np.unique(hashes, return_inverse=True)
        if self.table is not None:
            at = np.minimum(np.searchsorted(self.table, names), max(0, len(self.table) - 1))
            place = np.where(self.table[at] == names, at, -1) if len(self.table) else np.full(len(names), -1)
            on = place[which] >= 0
            owner, which, counts = owner[on], which[on], counts[on]
            names = place
        size = max(1, len(names))
        cells, back = np.unique(owner * size + which, return_inverse=True)  # a stem adds up the words that share it
        terms, total = names[cells % size], np.bincount(back, counts, len(cells)).astype(np.int64)
        cuts = np.searchsorted(cells, np.arange(len(texts) + 1) * size)
        return [(terms[a:z], total[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors of examples, for many queries at once."""

    def __init__(self, starts: np.ndarray, places: np.ndarray, weights: np.ndarray, example: np.ndarray) -> None:
        """Postings by term, then place, from starts[t] to starts[t + 1]; ``example``: which one stands at each place."""
        self.starts, self.places, self.weights, self.example = starts, places, weights, example
        self.n = len(example)
        self.matrix: np.ndarray | None = None
        self.watch = False  # whether the postings looked at are counted
        self.scored = self.whole = 0

    @classmethod
    def of_vectors(cls, start: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int) -> BlockMaxIndex:
        """Vector e: ``terms`` (below ``size``) and ``weights`` from start[e] to start[e + 1]."""
        lead = np.stack([heaviest(terms[a:z], weights[a:z], size) for a, z in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)])
        example = together(lead)
        place = np.empty(len(example), np.int64)
        place[example] = np.arange(len(example))
        at = np.repeat(place, np.diff(start))
        by = np.lexsort([at, terms])
        return cls(np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=size))]).astype(np.int32), at[by].astype(np.uint16), weights[by].astype(np.float32), example)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"matrix": None}  # made in each process

    def _prepare(self) -> None:
        """Block maxima, norms and weights of the common terms."""
        df = np.diff(self.starts)
        group = np.searchsorted(np.array(SHARES) * self.n, df, side="left")  # 0: a rare term
        common = np.flatnonzero(group)
        common = common[np.argsort(group[common], kind="stable")]
        self.column = np.full(len(df), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.cuts = np.searchsorted(group[common], np.arange(1, len(SHARES) + 2))  # columns of each group
        self.blocks = max(1, -(-self.n // BLOCK))
        matrix = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        for c, t in enumerate(common):
            s = slice(self.starts[t], self.starts[t + 1])
            matrix[self.places[s], c] = self.weights[s]
        self.highest = matrix.reshape(self.blocks, BLOCK, -1).max(1)
        parts = [slice(x, y) for x, y in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.norms = np.stack([np.sqrt(np.einsum("ij,ij->i", matrix[:, s], matrix[:, s], dtype=np.float64)) for s in parts], 1)
        self.place_of = np.empty(self.n, np.int64)
        self.place_of[self.example] = np.arange(self.n)
        self.matrix = matrix

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """(example, cosine) of the k nearest with a common term for each query (terms, weights), best first, ties
        by example; ``without`` leaves one example out for each."""
        if self.matrix is None:
            self._prepare()
        out = []
        for at in range(0, len(queries), TOGETHER):
            out += self._top(queries[at : at + TOGETHER], k, without[at : at + TOGETHER] if without else None)
        return out

    def _sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What these terms of a query give each place."""
        begin = self.starts[terms]
        many = self.starts[terms + 1] - begin
        total = int(many.sum())
        self.scored += total
        if not total:
            return np.zeros(self.blocks * BLOCK)
        step = np.ones(total, np.int32)  # places in the lists: on by one, and on to the next list at its end
        lists = np.flatnonzero(many)
        begin, many, weights = begin[lists], many[lists], weights[lists]
        first = np.cumsum(many) - many
        step[0], step[first[1:]] = begin[0], begin[1:] - (begin[:-1] + many[:-1] - 1)
        post = np.cumsum(step, dtype=np.int32)
        return np.bincount(self.places.take(post), np.repeat(weights, many) * self.weights.take(post), self.blocks * BLOCK)

    def _top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None) -> list[list[tuple[int, float]]]:
        m = len(queries)
        own = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])
        if self.watch:
            self.whole += int((self.starts[terms + 1] - self.starts[terms]).sum())
        column = self.column[terms]
        common = column >= 0
        wanted = np.zeros((m, self.matrix.shape[1]))
        wanted[own[common], column[common]] = weights[common]
        rare = np.flatnonzero(~common)
        cuts = np.searchsorted(own[rare], np.arange(m + 1))
        sums = np.stack([self._sums(terms[rare[x:y]], weights[rare[x:y]]) for x, y in pairwise(cuts.tolist())])
        if without is not None:
            sums[np.arange(m), self.place_of[without]] = -10.0
        groups = len(self.cuts) - 1
        norm = np.sqrt(np.diff(np.concatenate([np.zeros((m, 1)), np.cumsum(wanted**2, 1)], 1)[:, self.cuts], axis=1).clip(0)) + 1e-9
        single = wanted.astype(np.float32)
        by_block = np.stack([single[:, x:y] @ self.highest[:, x:y].T for x, y in zip(self.cuts[:-1], self.cuts[1:], strict=True)], 1).astype(np.float64)
        by_block = np.cumsum(by_block[:, ::-1], 1)[:, ::-1]  # what this group and those after it can give a block at most
        eps = (wanted.shape[1] + 4) * 2.0**-23 * (wanted @ self.highest.max(0, initial=0)) + 1e-9  # rounding of a single-precision product
        by_block += eps[:, None, None]
        bound = sums + np.minimum(norm @ self.norms.T + 1e-9, np.repeat(by_block[:, 0], BLOCK, axis=1))
        late = [(terms[x][np.argsort(column[x])], weights[x][np.argsort(column[x])], np.sort(column[x])) for x in (np.flatnonzero(common & (own == q)) for q in range(m))]
        return [self._finish(sums[q], bound[q], wanted[q], single[q], norm[q], by_block[q], eps[q], late[q], groups, k) for q in range(m)]

    def _rest(self, at: np.ndarray, single: np.ndarray, group: int) -> np.ndarray:
        """What ``group`` and those after it give these places, in single precision."""
        rows = self.matrix[at]
        if self.watch:
            self.scored += int(np.count_nonzero(rows[:, np.flatnonzero(single)][:, np.count_nonzero(single[: self.cuts[group]]) :]))
        return rows[:, self.cuts[group] :] @ single[self.cuts[group] :]

    def _finish(self, sums: np.ndarray, bound: np.ndarray, wanted: np.ndarray, single: np.ndarray, norm: np.ndarray, by_block: np.ndarray, eps: float, late: tuple, groups: int, k: int) -> list[tuple[int, float]]:
        """The k nearest of one query whose rare terms are summed, from the bounds of all places."""
        terms, weights, column = late
        limit, at, g = 1e-12, np.flatnonzero(bound > 0), 0
        sums, bound = sums[at], bound[at]
        while True:
            lead = np.argpartition(bound, len(at) - LEAD)[-LEAD:] if len(at) > LEAD else np.arange(len(at))
            if len(lead) >= k:
                scored = sums[lead] + self._rest(at[lead], single, g)
                limit = max(limit, np.partition(scored, len(lead) - k)[len(lead) - k] - eps)
            on = bound >= limit
            at, sums = at[on], sums[on]
            if len(at) <= FEW or g == groups:
                break
            s = slice(*np.searchsorted(column, self.cuts[g : g + 2]))
            sums = sums + self._sums(terms[s], weights[s])[at]
            g += 1
            bound = sums
            if g < groups:
                bound = sums + np.minimum(self.norms[at, g:] @ norm[g:] + 1e-9, by_block[g, at // BLOCK])
        rough = sums + self._rest(at, single, g)
        if len(at) > k:  # those that single precision can't tell from the k-th are scored in double precision
            on = rough >= np.partition(rough, len(at) - k)[len(at) - k] - 2 * eps
            at, sums = at[on], sums[on]
        cosine = (sums + self.matrix[at, self.cuts[g] :].astype(np.float64) @ wanted[self.cuts[g] :]).round(12)
        name = self.example[np.minimum(at, self.n - 1)]
        best = np.lexsort([name, -cosine])[:k]
        return [(int(name[x]), float(cosine[x])) for x in best if cosine[x] > 0]


def heaviest(terms: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The 8 heaviest terms of a vector, filled up with ``size``."""
    out = np.full(8, size, np.int64)
    first = np.lexsort([terms, -weights.round(3)])[:8]
    out[: len(first)] = terms[first]
    return out


def together(lead: np.ndarray) -> np.ndarray:
    """An order of vectors in which those with the same heaviest terms are neighbours."""
    return np.lexsort([np.arange(len(lead)), *lead.T[::-1]])


def association(a: np.ndarray, c: np.ndarray, ones: float, zeros: float) -> np.ndarray:
    """a(term): from ``FLOOR`` to 1 by the log-likelihood ratio of term and label; a and c of ones and zeros have the term."""
    n = max(1.0, ones + zeros)

    def part(x: np.ndarray, row: np.ndarray, column: float) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) * n / np.maximum(row * column, 1e-300)), 0.0)

    b, d = ones - a, zeros - c
    g2 = np.maximum(0, 2 * (part(a, a + c, ones) + part(b, b + d, ones) + part(c, a + c, zeros) + part(d, b + d, zeros)))
    return FLOOR + (1 - FLOOR) * (g2 / (g2 + HALF)) ** 2


class ToxicityModel:
    """Examples in order of their ids, with their labels and an index of their vectors."""

    def __init__(self, table: np.ndarray, factor: np.ndarray, ids: list, y: np.ndarray, bare: np.ndarray, index: BlockMaxIndex) -> None:
        """table: all terms, ascending, with the factors of their weights; bare: examples without a term."""
        self.table, self.factor, self.ids, self.y, self.index = table, factor, ids, y, index
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.bare = (y[bare].sum() + 1) / (bare.sum() + 2)
        self.cache: dict[bytes, tuple[float, list]] = {}

    def near(self, counted: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """The nearest examples of texts with terms, given as (terms, counts)."""
        vectors = [(t, (1 + np.log(c)) * self.factor[t]) for t, c in counted]
        return self.index.top([(t, w / np.sqrt((w**2).sum())) for t, w in vectors], K, without)

    def vote(self, near: list[tuple[int, float]]) -> float:
        w = [1 / (SOFT + max(0.0, 1 - c)) for _, c in near]
        return (sum(x * self.y[e] for x, (e, _) in zip(w, near, strict=True)) + self.prior) / (sum(w) + 1)

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]], curve: tuple[float, float]) -> list[tuple[float, list]]:
        """(score by this logistic curve of the vote, [(doc_id, label, cosine) of the three nearest]) of each text."""
        a, b = curve
        keys = [xxhash.xxh3_128_digest(t.tobytes() + c.tobytes()) if len(t) else b"" for t, c in counted]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        new = {key: i for i, key in enumerate(keys) if key and key not in self.cache}
        for key, near in zip(new, self.near([counted[i] for i in new.values()]), strict=True):
            v = self.vote(near)
            self.cache[key] = float(1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b)))), [(self.ids[e], int(self.y[e]), c) for e, c in near[:3]]
        return [self.cache[key] if key else (float(self.bare), []) for key in keys]


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve on the log-odds of the votes."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * (beta - [1, 0]))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _examples(docs: DataFrame, labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """(doc_id, y, terms, counts): the examples; terms as binary longs and counts as binary ints."""
    rows = examples(docs, labels, column, learn, EXAMPLES)
    added = [T.StructField("sign", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]

    def run(texts: list[bytes]) -> list[pa.Array]:
        held = TermCounter()(texts)
        sign = [xxhash.xxh3_128_digest(b" ".join(tokens(t))) for t in texts]
        cells = ([t.tobytes() for t, _ in held], [c.astype(np.int32).tobytes() for _, c in held])
        return [pa.array(sign, pa.binary()), pa.array([len(t) for t, _ in held], pa.int64()), *(pa.array(c, pa.binary()) for c in cells)]

    signed = staged(with_texts(rows, ["doc_id", "y"], added, run), "examples")
    first = signed.groupBy("sign", "y").agg(F.min(F.struct("doc_id", "n")).alias("r"))
    first = staged(first.select("r.doc_id", "r.n", F.xxhash64(F.col("r.doc_id").cast("string")).alias("h")), "chosen")
    size = first.select("h", "n").toPandas().sort_values("h")  # at most EXAMPLES
    if size["n"].sum() > POSTINGS:
        first = first.filter(F.col("h") < int(size["h"].to_numpy()[(size["n"].cumsum() > POSTINGS).to_numpy().argmax()]))
    return signed.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi").select("doc_id", "y", "terms", "counts")


def _term_table(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of the examples, ascending, and how many of label 1 and 0 have each; counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy() // 8
            terms, which = np.unique(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64), return_inverse=True)
            y = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array(np.bincount(which, y == v, len(terms)).astype(np.int64)) for v in (1, 0))], ["term", "a", "c"])

    rows = examples.select("y", "terms").mapInArrow(run, "term long, a long, c long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    found = rows.toArrow().sort_by("term")  # a row per term of the sample
    return tuple(found[c].to_numpy() for c in ("term", "a", "c"))


def _index(examples: DataFrame, ids: list, table: np.ndarray, factor: np.ndarray) -> BlockMaxIndex:
    """The index over the examples, whose postings are weighted, dealt by term and sorted in tasks."""
    spark, size = examples.sparkSession, len(table)
    held = spark.sparkContext.broadcast((table, factor))

    def vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        known, factors = held.value
        for i, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            terms = np.searchsorted(known, np.frombuffer(t, np.int64))
            w = (1 + np.log(np.frombuffer(c, np.int32))) * factors[terms]
            yield i, terms, w / np.sqrt(max((w**2).sum(), 1e-300))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, heaviest(t, w, size)) for i, t, w in vectors(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], batch.schema.types[0]), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "lead"])

    rows = examples.select("doc_id", "terms", "counts")
    lead = rows.mapInArrow(leads, T.StructType([rows.schema["doc_id"], T.StructField("lead", T.ArrayType(T.LongType()))])).toArrow()  # at most EXAMPLES
    number = {i: e for e, i in enumerate(ids)}
    first = np.full((len(ids), 8), size, np.int64)
    for i, x in zip(lead["doc_id"].to_pylist(), lead["lead"].to_pylist(), strict=True):
        first[number[i]] = x
    example = together(first)
    place = spark.sparkContext.broadcast({ids[e]: p for p, e in enumerate(example.tolist())})

    low = [-(-x * size // PARTS) for x in range(PARTS + 1)]  # the terms of each part

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, terms, w in vectors(batch):
                for part, (x, y) in enumerate(pairwise(np.searchsorted(terms, low).tolist())):
                    if x < y:
                        out.append((part, place.value[i], terms[x:y].astype(np.int32).tobytes(), w[x:y].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "place", "terms", "w"])

    def lists(key: tuple, own: pa.Table) -> pa.Table:
        part = key[0].as_py()
        terms, w = (np.frombuffer(b"".join(own[c].to_pylist()), kind) for c, kind in (("terms", np.int32), ("w", np.float32)))
        at = np.repeat(own["place"].to_numpy(), pc.binary_length(own["w"]).to_numpy() // 4)
        by = np.lexsort([at, terms])
        df = np.bincount(terms - low[part], minlength=low[part + 1] - low[part]).astype(np.int32)
        cells = [df.tobytes(), at[by].astype(np.uint16).tobytes(), w[by].tobytes()]
        return pa.Table.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["part", "df", "places", "weights"])

    dealt = rows.mapInArrow(postings, "part int, place int, terms binary, w binary").groupBy("part")
    found = dealt.applyInArrow(lists, "part int, df binary, places binary, weights binary").toArrow().sort_by("part")  # PARTS rows
    df, places, weights = (np.frombuffer(b"".join(found[c].to_pylist()), kind) for c, kind in (("df", np.int32), ("places", np.uint16), ("weights", np.float32)))
    held.destroy()
    place.destroy()
    have = set(found["part"].to_pylist())
    if len(have) < PARTS:  # parts without a term
        full, at = np.zeros(size, np.int32), 0
        for p in sorted(have):
            full[low[p] : low[p + 1]] = df[at : at + low[p + 1] - low[p]]
            at += low[p + 1] - low[p]
        df = full
    return BlockMaxIndex(np.concatenate([[0], np.cumsum(df)]).astype(np.int32), places, weights, example)


def _frequencies(docs: DataFrame, table: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold each term of the table, and the number of documents."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, df, n = TermCounter(held.value), np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for t, _ in count(batch.column(0).slice(at, 512).to_pylist()):
                    df[t] += 1
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], ["place", "n"])

    rows = docs.select(text_bytes().alias("t")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # a row per term of the sample
    held.destroy()
    out = np.zeros(len(table) + 1, np.int64)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()  # place -1: the number of documents
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, column: str, learn: Column) -> tuple[Broadcast, tuple[float, float]]:
    """The model of ``labels.column`` from documents that may be learnt from, and the curve of its votes."""
    spark = docs.sparkSession
    table = _examples(docs, labels, column, learn)
    rows = table.select("doc_id", "y", (F.octet_length("terms") == 0).alias("bare")).orderBy("doc_id").toArrow()  # at most EXAMPLES
    y, ids, bare = rows["y"].to_numpy().astype(np.int64), rows["doc_id"].to_pylist(), np.array(rows["bare"].to_pylist(), bool)
    known, a, c = _term_table(table)
    df, n = _frequencies(docs, known)
    factor = (np.log((n + 1) / (df + 1)) + 1e-6) * association(a, c, float(y.sum()), float(len(y) - y.sum()))
    held = spark.sparkContext.broadcast(ToxicityModel(known, factor, ids, y, bare, _index(table, ids, known, factor)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {i: e for e, i in enumerate(held.value.ids)}
        for batch in batches:
            rows = [r for r in zip(*(x.to_pylist() for x in batch.columns), strict=True) if r[2]]
            counted = [(np.searchsorted(held.value.table, np.frombuffer(t, np.int64)), np.frombuffer(c, np.int32)) for _, _, t, c in rows]
            votes = [held.value.vote(x) for x in held.value.near(counted, [place[r[0]] for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array([r[1] for r in rows], pa.int32())], ["v", "y"])

    dealt = table.repartition(4 * spark.sparkContext.defaultParallelism)
    votes = dealt.mapInArrow(run, "v double, y int").toPandas().sort_values(["v", "y"])
    return held, _logistic(votes["v"].to_numpy(), votes["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, column: str, learn: Column, keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless kept) with ``score`` and ``evidence``."""
    model, curve = fit(docs, labels, column, learn)
    id_type = docs.schema["doc_id"].dataType
    near = T.StructType([T.StructField("doc_id", id_type), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    arrow = pa.list_(pa.struct([("doc_id", to_arrow_type(id_type)), ("toxic", pa.int32()), ("cosine", pa.float64())]))
    added = [T.StructField(free_name(docs.columns, "score"), T.DoubleType()), T.StructField(free_name(docs.columns, "evidence"), T.ArrayType(near))]
    counters: list[TermCounter] = []

    def run(texts: list[bytes]) -> list[pa.Array]:
        if not counters:
            counters.append(TermCounter(model.value.table))
        rows = model.value.scores(counters[0](texts), curve)
        why = [[{"doc_id": d, "toxic": y, "cosine": s} for d, y, s in r] for _, r in rows]
        return [pa.array([s for s, _ in rows], pa.float64()), pa.array(why, arrow)]

    return with_texts(docs, [c for c in docs.columns if keep_text or c != "text"], added, run)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest examples of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", ~fold(5, 0), keep_text=False)
    return out.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


QUERIES = {"op2_toxicity": op2_toxicity}
#: A fitted model; tests hold the search against brute force and the scores by held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
