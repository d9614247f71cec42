"""Positions of regular-expression matches, with SQL functions only.

``split`` gives the text between matches and ``regexp_extract_all`` the matches; running sums of
their lengths in code points are the positions.  Patterns here are written so that Java's matcher
runs in time linear in the text: possessive quantifiers where giving characters back can't help,
and a start only where the run of characters starts or the last match ended (``\\G``).
"""

from __future__ import annotations

RUN, CHUNK = 128, 1_024
NONE = "cast(array() as array<struct<s:int,e:int,v:string,g:string>>)"


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    assert "'" not in pattern or '"' not in pattern
    return f"r'{pattern}'" if "'" not in pattern else f'r"{pattern}"'


def bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def found(text: str, pattern: str, group: int = 0) -> str:
    """SQL: array of (s, e, v, g) for each match: start, end (exclusive), match, group.

    The running sums go in runs of ``RUN`` matches, so no long array is copied for every match.
    """
    p = literal(pattern)
    matches, groups = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {group})"
    rows = f"zip_with(zip_with(slice(split({text}, {p}), 1, size(ms)), ms, (a, m) -> struct(length(a) AS gap, m AS m)), {groups if group else 'ms'}, (x, g) -> struct(x.gap AS gap, length(x.m) AS n, x.m AS m, g AS g))"
    step = "struct(acc.at + x.gap + x.n AS at, concat(acc.out, array(struct(acc.at + x.gap AS s, acc.at + x.gap + x.n AS e, x.m AS v, x.g AS g))) AS out)"
    part = f"slice(rs, i * {RUN} + 1, {RUN})"
    runs = f"sequence(0, (size(rs) - 1) div {RUN})"
    sums = f"transform({runs}, i -> aggregate({part}, 0, (acc, x) -> acc + x.gap + x.n))"
    before = f"aggregate({sums}, struct(0 AS at, cast(array() as array<int>) AS out), (acc, n) -> struct(acc.at + n AS at, concat(acc.out, array(acc.at)) AS out), acc -> acc.out)"
    each = f"flatten(transform({runs}, i -> aggregate({part}, struct(bs[i] AS at, {NONE} AS out), (acc, x) -> {step}, acc -> acc.out)))"
    return f"CASE WHEN {text} RLIKE {p} THEN {bound(matches, 'ms', bound(rows, 'rs', bound(before, 'bs', each)))} ELSE {NONE} END"


def chunks(text: str) -> str:
    """SQL: the text in pieces of ``CHUNK`` code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def around(pieces: str, s: str, v: str, e: str, width: int) -> str:
    """SQL: match ``v`` from s to e with up to ``width`` code points on either side, from ``chunks``."""

    def cut(at: str, length: str) -> str:
        both = f"concat(coalesce(get({pieces}, ({at}) div {CHUNK}), ''), coalesce(get({pieces}, ({at}) div {CHUNK} + 1), ''))"
        return f"substring({both}, ({at}) % {CHUNK} + 1, {length})"

    return f"concat({cut(f'greatest({s} - {width}, 0)', f'least({s}, {width})')}, {v}, {cut(e, str(width))})"


def clear_of(rows: str, base: str) -> str:
    """SQL: those of ``rows`` (s, e) that no span of ``base`` overlaps; base spans are looked up by chunk."""
    by = f"transform(sequence(0, array_max(transform({base}, b -> b.e)) div {CHUNK}), i -> filter({base}, b -> b.s < (i + 1) * {CHUNK} AND b.e > i * {CHUNK}))"
    near = f"flatten(transform(sequence(y.s div {CHUNK}, (y.e - 1) div {CHUNK}), i -> coalesce(get(cs, i), array())))"
    some = bound(by, "cs", f"filter(ys, y -> NOT exists({near}, b -> b.s < y.e AND y.s < b.e))")
    return bound(rows, "ys", f"CASE WHEN size(ys) = 0 OR size({base}) = 0 THEN ys ELSE {some} END")


def joined(parts: str) -> str:
    """SQL: ``kind:start:end`` of an array of (kind, s, e), comma-joined."""
    return f"concat_ws(',', transform({parts}, x -> concat(x.kind, ':', x.s, ':', x.e)))"


def sha(text: str) -> str:
    return f"sha2(cast({text} as binary), 256)"
