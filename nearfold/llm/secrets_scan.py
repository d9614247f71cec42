"""Secret scans: a battery of randomness tests on tokens, with length-aware false-discovery control.

SQL functions only.  Base kinds are assign, access and hex.  The method adds ``random``: a token of
``MIN_LEN`` or more characters from the base64 and URL alphabets whose characters look drawn at random;
one that overlaps a base span is left out.  For each token the narrowest encoding that holds all its characters is inferred (hex,
lower, upper, lower-alphanumeric, alphanumeric, base64 and its URL form).  Then

* chi-squared uniformity over that alphabet gives X.  For written language with coincidence index
  ``LANGUAGE_IC`` X has mean df + n * shift and variance 2 * (df + 2 n * shift), where shift =
  IC * m - 1; ``p`` is the chance of an X as small as this from language.  The longer the token, the
  smaller p can get; a short token can't reach significance whatever it holds;
* a runs test about the middle of the alphabet and the lag-1 serial correlation, both within
  ``Z_LIMIT`` standard errors, exclude counting sequences and repeated patterns.

False discoveries: within each length class Benjamini-Hochberg at ``ALPHA`` over all tokens of the
corpus.  Tokens are counted in bins of log10 p (a table of fixed size), and the limit is the
largest bin edge that the procedure admits, so no global sort is needed.

Defined cases: a null or empty text has no spans, and its digests are those of the empty string;
repeated rows and null doc_ids are kept row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, free_name, staged
from .spans import clear_of, found, joined, sha

MIN_LEN = 20
LANGUAGE_IC = 0.065
Z_LIMIT = 3.3
ALPHA = 0.001
BINS = 300
KINDS = ("assign", "access", "hex", "random")

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]++",
    # [0-9a-f]+ of 24 or more: shorter runs can't hold a longer one
    "hex": r"[0-9a-f]{24,}+",
    "random": rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LEN},}}+={{0,2}}",
}
VALID = {
    "assign": "length(x.g) >= 6",
    "access": "length(x.v) >= 20",
    "hex": "true",
    "random": "true",
}
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern of the whole token, alphabet), narrowest first.
ENCODINGS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z_-]+$", DIGITS + UPPER + LOWER + "_-"),
)
WIDEST = DIGITS + UPPER + LOWER + "+/"


def _alphabet(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} RLIKE '{p}' THEN '{a}'" for p, a in ENCODINGS) + f" ELSE '{WIDEST}' END"


def _battery() -> str:
    """SQL over x (kind, s, e, v): struct with log-p bin (null if a test excludes it) and length class."""
    token = "rtrim('=', x.v)"
    chars = f"filter(split({token}, ''), c -> c != '')"
    first = f"transform(array(struct({chars} AS c, {_alphabet(token)} AS a, {token} AS t)), y -> struct(y.t AS t, y.a AS a, transform(y.c, q -> instr(y.a, q) - 1) AS i, length(y.a) AS m, size(y.c) AS n))"
    # one count a letter, and one of all characters outside the alphabet
    square = "aggregate(split(y.a, ''), power(length(translate(y.t, y.a, '')), 2), (acc, u) -> acc + power(y.n - length(replace(y.t, u, '')), 2))"
    above = "transform(y.i, w -> CASE WHEN w >= y.m / 2 THEN 1 ELSE 0 END)"
    second = f"transform({first}, y -> struct(y.i AS i, y.m AS m, double(y.n) AS n, {square} * y.m / y.n - y.n AS chi, {above} AS up, aggregate(y.i, 0D, (acc, w) -> acc + w) / y.n AS mean))"
    pair = lambda a, f: f"aggregate(zip_with(slice({a}, 1, size({a}) - 1), slice({a}, 2, size({a}) - 1), (p, q) -> {f}), 0D, (acc, w) -> acc + w)"
    n1 = "aggregate(y.up, 0D, (acc, w) -> acc + w)"
    var = "aggregate(y.i, 0D, (acc, w) -> acc + power(w - y.mean, 2))"
    third = f"transform({second}, y -> struct(y.m AS m, y.n AS n, y.chi AS chi, {n1} AS n1, y.n - {n1} AS n2, 1 + {pair('y.up', 'CASE WHEN p != q THEN 1D ELSE 0D END')} AS runs, {pair('y.i', '(p - y.mean) * (q - y.mean)')} AS cov, {var} AS var))"
    shift = f"greatest({LANGUAGE_IC}D * y.m - 1, 0.1D)"
    z = f"(y.chi - (y.m - 1) - y.n * {shift}) / sqrt(2 * (y.m - 1 + 2 * y.n * {shift}))"
    mu = "(2 * y.n1 * y.n2 / y.n + 1)"
    z_runs = f"CASE WHEN y.n1 * y.n2 = 0 THEN 99D ELSE (y.runs - {mu}) / sqrt(greatest(({mu} - 1) * ({mu} - 2) / (y.n - 1), 1e-9D)) END"
    z_serial = "CASE WHEN y.var = 0 THEN 99D ELSE y.cov / y.var * sqrt(y.n) END"
    # the normal tail by a closed form within 0.3% at any distance, as a logarithm so that it can't underflow
    tail = lambda x: f"(-power({x}, 2) / 2 * log10(e()) - log10(sqrt(2 * pi()) * (0.661D * {x} + 0.339D * sqrt(power({x}, 2) + 5.51D))))"
    log_p = f"CASE WHEN {z} < 0 THEN {tail(f'abs({z})')} ELSE log10(1 - power(10D, {tail(f'abs({z})')})) END"
    bin_ = f"CASE WHEN abs({z_runs}) > {Z_LIMIT} OR abs({z_serial}) > {Z_LIMIT} THEN NULL ELSE int(least({BINS}D, greatest(0D, floor(-10 * ({log_p}))))) END"
    return f"element_at(transform({third}, y -> struct({bin_} AS bin, int(least(5D, floor(log2(y.n / {MIN_LEN}D)))) AS cls)), 1)"


def _kind(text: str, kind: str) -> str:
    group = 1 if kind == "assign" else 0
    return f"transform(filter({found(text, PATTERNS[kind], group)}, x -> {VALID[kind]}), x -> struct('{kind}' AS kind, x.s AS s, x.e AS e, x.v AS v))"


def _limits(rows: DataFrame, cand: str, out: str) -> DataFrame:
    """One row: map from length class to the lowest bin that the procedure admits."""
    bins = rows.select(F.explode(cand).alias("c")).groupBy(F.col("c.cls").alias("cls"), F.coalesce("c.bin", F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("cls").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("above", F.sum("n").over(down)).withColumn("all", F.sum("n").over(W.partitionBy("cls")))
    admitted = bins.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= ALPHA * F.col("above") / F.col("all")).groupBy("cls").agg(F.min("bin").alias("bin"))
    return admitted.agg(F.map_from_entries(F.collect_list(F.struct("cls", "bin"))).alias(out))


def secret_spans(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, s, e), by start, then kind as listed.

    Without ``keep_text`` the column ``text`` goes, and only the spans are staged.
    """
    body, out, found_, free_, cand, limits = (free_name(docs.columns, c) for c in ("nf_body", "secrets", "nf_base", "nf_free", "nf_cand", "nf_limits"))
    columns = [c for c in docs.columns if keep_text or c != "text"]
    rows = docs.withColumn(body, F.coalesce(F.col("text"), F.lit("")))
    base = ", ".join(_kind(f"`{body}`", k) for k in KINDS[:3])
    rows = rows.withColumn(found_, F.expr(f"transform(concat({base}), x -> struct(x.kind AS kind, x.s AS s, x.e AS e))"))
    rows = rows.withColumn(free_, F.expr(clear_of(_kind(f"`{body}`", "random"), f"`{found_}`")))
    rows = rows.withColumn(cand, F.expr(f"transform(`{free_}`, x -> struct(x.s AS s, x.e AS e, {_battery()} AS t))"))
    rows = rows.withColumn(cand, F.expr(f"transform(`{cand}`, x -> struct(x.s AS s, x.e AS e, x.t.bin AS bin, x.t.cls AS cls))")).drop(free_, body)
    rows = staged(rows.select(*columns, found_, cand), "candidates")
    rows = rows.crossJoin(F.broadcast(_limits(rows, cand, limits)))  # one row
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    kept = f"transform(filter(`{cand}`, c -> c.bin IS NOT NULL AND c.bin >= coalesce(try_element_at(`{limits}`, c.cls), 999)), c -> struct('random' AS kind, c.s AS s, c.e AS e))"
    ordered = f"transform(array_sort(transform(concat(`{found_}`, {kept}), x -> struct(x.s AS s, {rank} AS rank, x.e AS e, x.kind AS kind))), x -> struct(x.kind AS kind, x.s AS s, x.e AS e))"
    return rows.withColumn(out, F.expr(ordered)).select(*columns, out)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of every document."""
    out = secret_spans(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    counts = [F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = joined("filter(secrets, x -> x.kind != 'random')")
    return out.select("doc_id", *counts[:3], F.expr(sha(base)).alias("base_sha256"), F.expr(joined("secrets")).alias("spans"), counts[3])


QUERIES = {"op8_secrets": op8_secrets}
#: SQL engines without look-around can't state the added kind; tests hold all spans of whole tables, added ones too, against plain Python.
ORACLE_SQL: dict[str, str] = {}
