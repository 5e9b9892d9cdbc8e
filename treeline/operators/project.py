"""Ops that work row by row: projection, mapping, filtering, numbers, strings, dates."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import dates
from treeline.functions.rpn import calculated
from treeline.operators.registry import op
from treeline.plans.rows import N, Rows


@op("order")
def order(rows: Rows, args: str) -> Rows:
    """``order=2,0``: these columns in this order, the others go."""
    names = [rows.name(a) for a in args.split(",")]
    return replace(rows, columns=tuple(names))


@op("ordermap")
def order_map(rows: Rows, args: str) -> Rows:
    """``t,text,from,to[:...]``: where column t is the text, column to becomes column from."""
    for part in args.split(":"):
        test, text, source, target = part.split(",")
        rows = rows.with_column(rows.name(target), F.when(rows.col(test).cast("string") == text, rows.col(source)).otherwise(rows.col(target)))
    return rows


@op("map")
def map_values(rows: Rows, args: str) -> Rows:
    """``column::{"from": "to"}``: exact values; others stay."""
    ref, _, table = args.partition("::")
    pairs = [F.lit(str(x)) for kv in json.loads(table).items() for x in kv]
    value = rows.col(ref).cast("string")
    return rows.with_column(rows.name(ref), F.coalesce(F.try_element_at(F.create_map(*pairs), value), value))


@op("rmap")
def map_patterns(rows: Rows, args: str) -> Rows:
    """``column::{"regex": "to"}``: whole-value matches of the value as it was; the last pattern that matches wins."""
    ref, _, table = args.partition("::")
    value = out = rows.col(ref).cast("string")
    for pattern, to in json.loads(table).items():
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(str(to))).otherwise(out)
    return rows.with_column(rows.name(ref), out)


@op("compare")
def compare(rows: Rows, args: str) -> Rows:
    """``column:op:number`` with lt, lteq, eq, gteq, gt (a first letter will do). What is no number counts as 0."""
    ref, how, number = args.split(":")
    if not rows.has(ref):
        return rows
    value, limit = F.coalesce(rows.number(ref, "bigint"), F.lit(0)), int(number)
    either = how.endswith("eq")
    tests = {"l": value <= limit if either else value < limit, "g": value >= limit if either else value > limit, "e": value == limit}
    return rows.filter(tests[how[0]])


@op("contains")
def contains(rows: Rows, args: str) -> Rows:
    """``column:s1,s2``: rows whose value has any of the texts in it."""
    ref, _, texts = args.partition(":")
    found = F.lit(False)
    for t in texts.split(","):
        found = found | F.coalesce(rows.col(ref).cast("string").contains(t), F.lit(False))
    return rows.filter(found)


@op("filter")
def filter_rows(rows: Rows, args: str) -> Rows:
    """``filter={json}``: any bundle filter; rows it refuses go."""
    from treeline.functions.bundle_filters import apply

    return apply(rows, json.loads(args))


op("num", "math")(calculated)


@op("str")
def strings(rows: Rows, args: str) -> Rows:
    """Reverse Polish strings: cN column, vS text (v alone: a comma), + joins, : cuts by (from, to), / splits by
    (separator, place), = writes (value, column), == and != keep or drop rows."""
    stack: list[Column] = []
    constants: list[str] = []
    keep: list[Column] = []
    for token in args.split(","):
        if token.startswith("c") and rows.has(token[1:]):
            stack.append(rows.col(token[1:]).cast("string"))
        elif token.startswith("v"):
            constants.append(token[1:] or ",")
            stack.append(F.lit(constants[-1]))
        elif token in ("+", "cat"):
            b, a = stack.pop(), stack.pop()
            stack.append(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        elif token in (":", "range"):
            stack.pop(), stack.pop()
            end, begin = int(constants.pop()), int(constants.pop())
            value = stack.pop()
            at = lambda k, v: F.lit(k) if k >= 0 else F.greatest(F.length(v) + k, F.lit(0))
            first, last = at(begin, value), at(end, value) if end else F.length(value)
            stack.append(F.substr(value, first + 1, F.greatest(last - first, F.lit(0))))
        elif token in ("/", "split"):
            stack.pop(), stack.pop()
            place, by = int(constants.pop()), constants.pop()
            parts = F.split(stack.pop(), "\\Q" + by + "\\E")
            stack.append(F.get(parts, F.lit(place) if place >= 0 else F.size(parts) + place))
        elif token in ("=", "set"):
            stack.pop()
            ref = constants.pop()
            rows = rows.with_column(rows.name(ref) if rows.has(ref) else rows.fresh(f"c{len(rows.columns)}"), stack.pop())
        elif token in ("==", "eq", "!=", "neq"):
            b, a = stack.pop(), stack.pop()
            keep.append(a.eqNullSafe(b) if token in ("==", "eq") else ~a.eqNullSafe(b))
        else:
            raise ValueError(f"str: no token {token!r}")
    for test in keep:
        rows = rows.filter(test)
    return rows


@op("datef")
def date_format(rows: Rows, args: str) -> Rows:
    """``columns:in:out[:column]``: the columns' texts, joined, from one time pattern to another."""
    refs, source, target, *where = args.split(":")
    refs = refs.split(",")
    text = F.concat(*[F.coalesce(rows.col(r).cast("string"), F.lit("")) for r in refs])
    name = where[0] if where else refs[0]
    return rows.with_column(rows.name(name) if rows.has(name) else name, dates.written(dates.read(text, source), target))


@op("fill")
def fill(rows: Rows, args: str) -> Rows:
    """``fill[=value]``: nulls become the value; i or l, f or d, s before it name its type; else 0."""
    kind, text = (args[0], args[1:]) if args[:1] and args[0] in "ilfds" else ("i", args)
    value = {"i": lambda: F.lit(int(text or 0)), "f": lambda: F.lit(float(text or 0)), "s": lambda: F.lit(text)}[{"l": "i", "d": "f"}.get(kind, kind)]()
    for c in rows.columns:
        rows = rows.with_column(c, F.coalesce(rows.col(c), value.cast(rows.kind(c)) if kind != "s" or isinstance(rows.kind(c), T.StringType) else value))
    return rows


@op("pad")
def pad(rows: Rows, args: str) -> Rows:
    """``fill:n``: at least n columns."""
    value, _, n = args.rpartition(":")
    while len(rows.columns) < int(n):
        rows = rows.with_column(rows.fresh(f"c{len(rows.columns)}"), F.lit(value or "0"))
    return rows


@op("title")
def title(rows: Rows, args: str) -> Rows:
    """A first row of titles: those given, or the columns' names. All columns become strings."""
    rows = rows.numbered()
    names = args.split(",") if args else list(rows.columns)
    names += [""] * (len(rows.columns) - len(names))
    body = rows.df.select(*[rows.col(c).cast("string").alias(c) for c in rows.columns], N)
    head = rows.df.sparkSession.range(1).select(*[F.lit(t).alias(c) for t, c in zip(names, rows.columns)], F.lit(-1).cast("long").alias(N))  # noqa: B905
    return Rows(head.unionByName(body), rows.columns, ((N, True),))
