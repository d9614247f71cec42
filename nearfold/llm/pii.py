"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

SQL functions only.  Base kinds (email, ip, card, phone) are kept by their own checks alone: parts
of an address at most 255, Luhn for cards of 16 to 19 digits, 8 to 15 digits for phones.  The
method adds ``iban`` (mod-97), ``card15`` (13 to 15 digits passing Luhn) and ``ssn``
(nnn-nn-nnnn); the last two need a context word within ``WINDOW`` code points to reach
``THRESHOLD``.  An added span that overlaps a base span is left out.

Defined cases: a null or empty text has no spans, and its digests are those of the empty string;
repeated rows and null doc_ids are kept row by row; an empty table gives an empty result; texts of
any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name
from .spans import around, bound, chunks, clear_of, found, joined, sha

WINDOW = 40
THRESHOLD = 0.7
CONTEXT_BONUS = 0.3
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card15", "ssn")

#: The base patterns, each equal to the plain form in its comment.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[0-9]|[\x20-][0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card15": r"[0-9](?:[0-9]|[\x20-][0-9])++",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "card15": 0.5, "ssn": 0.5}
WORDS = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "ip|address|host|server|adresse|servidor",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "card15": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "ssn": "ssn|social|security|tax",
}


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    d = _digits(v)
    x = f"int(substring({d}, -i, 1))"
    return f"aggregate(sequence(1, length({d})), 0, (acc, i) -> acc + CASE WHEN i % 2 = 0 THEN 2 * {x} - CASE WHEN {x} > 4 THEN 9 ELSE 0 END ELSE {x} END) % 10 = 0"


def _mod97(v: str) -> str:
    plain = f"replace({v}, ' ', '')"
    turned = f"split(concat(substring({plain}, 5), substring({plain}, 1, 4)), '')"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN (acc * 10 + int(c)) % 97 ELSE (acc * 100 + ascii(c) - 55) % 97 END"
    return f"length({plain}) BETWEEN 15 AND 34 AND aggregate({turned}, 0, (acc, c) -> CASE WHEN c = '' THEN acc ELSE {value} END) = 1"


def _short(part: str) -> str:
    return f"regexp_replace({part}, '^0+', '')"


VALID = {
    "email": "true",
    "ip": f"forall(split(x.v, '[.]'), q -> CASE WHEN length({_short('q')}) > 3 THEN false ELSE int(concat('0', {_short('q')})) <= 255 END)",
    "card": f"CASE WHEN length({_digits('x.v')}) BETWEEN 16 AND 19 THEN {_luhn('x.v')} ELSE false END",
    "phone": f"length({_digits('x.v')}) BETWEEN 8 AND 15",
    "iban": _mod97("x.v"),
    "card15": f"CASE WHEN length({_digits('x.v')}) BETWEEN 13 AND 15 THEN {_luhn('x.v')} ELSE false END",
    "ssn": "true",
}


def _kind(text: str, kind: str, base: str | None = None) -> str:
    """SQL: confirmed spans (kind, s, e, score) of a kind; those over a base span go."""
    near = around("ps", "x.s", "x.v", "x.e", WINDOW)
    score = f"least(1D, {SCORE[kind]}D + CASE WHEN {near} RLIKE '(?i){WORDS[kind]}' THEN {CONTEXT_BONUS}D ELSE 0D END)"
    scored = bound(chunks(text), "ps", f"transform(xs, x -> struct('{kind}' AS kind, x.s AS s, x.e AS e, {score} AS score))")
    none = "cast(array() as array<struct<kind:string,s:int,e:int,score:double>>)"
    rows = bound(f"filter({found(text, PATTERNS[kind])}, x -> {VALID[kind]})", "xs", f"CASE WHEN size(xs) = 0 THEN {none} ELSE {scored} END")
    return rows if base is None else clear_of(f"filter({rows}, y -> y.score >= {THRESHOLD})", base)


def pii_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: array of (kind, s, e, score), by kind as listed and start."""
    body, base, out = (free_name(docs.columns, c) for c in ("nf_body", "nf_base", "pii"))
    rows = docs.withColumn(body, F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn(base, F.expr("concat(" + ", ".join(_kind(f"`{body}`", k) for k in BASE) + ")"))
    added = ", ".join(_kind(f"`{body}`", k, f"`{base}`") for k in ADDED)
    return rows.withColumn(out, F.expr(f"concat(`{base}`, {added})")).drop(body, base)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``pii`` replaced by its kind in angle brackets.

    Where spans of two kinds overlap, the one that starts first (then ends last) is replaced.
    """
    tagged = pii_spans(docs)
    out = free_name(docs.columns, "pii")
    order = f"array_sort(`{out}`, (a, b) -> CASE WHEN a.s < b.s OR (a.s = b.s AND a.e > b.e) THEN -1 WHEN a.s = b.s AND a.e = b.e THEN 0 ELSE 1 END)"
    step = "CASE WHEN x.s < acc.at THEN acc ELSE struct(x.e AS at, concat(acc.out, substring(text, acc.at + 1, x.s - acc.at), '<', x.kind, '>') AS out) END"
    text = f"aggregate({order}, struct(0 AS at, '' AS out), (acc, x) -> {step}, acc -> concat(acc.out, substring(text, acc.at + 1)))"
    return tagged.withColumn("text", F.expr(f"CASE WHEN text IS NULL OR size(`{out}`) = 0 THEN text ELSE {text} END")).select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of every document."""
    out = pii_spans(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    names = ", ".join(f"'{k}'" for k in BASE)
    base = joined(f"filter(pii, x -> x.kind IN ({names}))")
    scores = "concat_ws(',', transform(pii, x -> cast(round(x.score, 2) as string)))"
    return out.select("doc_id", *counts, F.expr(sha(base)).alias("base_sha256"), F.expr(joined("pii")).alias("spans"), F.expr(scores).alias("scores"))


QUERIES = {"op5_pii": op5_pii}
#: SQL engines without look-around can't state the added kinds; tests hold all spans of whole tables, added ones too, against plain Python.
ORACLE_SQL: dict[str, str] = {}
