"""Sorting and cutting."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from treeline.operators.registry import op
from treeline.plans.rows import N, P, Rows


@op("sort", "dsort")
def sort(rows: Rows, args: str) -> Rows:
    """``columns:types:directions``: types i, l, n (long), d, f (double), s (text); directions a, d; a short list
    repeats its first letter. Nulls are last, descending first; ties keep their order."""
    refs, types, ups = (args.split(":") + ["", ""])[:3] if args else ("", "", "")
    refs = [r for r in refs.split(",") if r] or [str(k) for k in range(len(rows.columns))]
    letter = lambda given, k, default: (given[k] if k < len(given) else given[0]) if given else default
    keys = []
    for k, ref in enumerate(refs):
        kind = letter(types.replace(",", ""), k, "s")
        value = rows.number(ref, "bigint") if kind in "iln" else rows.number(ref, "double") if kind in "df" else rows.col(ref).cast("string")
        keys.append((value, letter(ups.replace(",", ""), k, "a") != "d"))
    return rows.sorted_by(keys)


@op("limit")
def limit(rows: Rows, args: str) -> Rows:
    """``n`` or ``skip:n``: the first rows."""
    skip, n = (int(x) for x in args.split(":")) if ":" in args else (0, int(args))
    df = rows.df.orderBy(*rows.sort_keys()) if rows.order else rows.df
    return replace(rows, df=df.offset(skip).limit(n) if skip else df.limit(n))


@op("skip")
def skip(rows: Rows, args: str) -> Rows:
    """``n[,on[,off]]``: without the first n rows, then runs of ``on`` rows kept and ``off`` rows left out."""
    n, *rest = (int(x) for x in args.split(","))
    rows = rows.numbered()
    keep = F.col(N) >= n
    if rest:
        on, off = rest[0], rest[1] if len(rest) > 1 else rest[0]
        keep = keep & (F.pmod(F.col(N) - n, F.lit(on + off)) < on)
    return rows.filter(keep)


@op("range")
def row_range(rows: Rows, args: str) -> Rows:
    """``begin[,end]``: rows from begin to before end; negative begins, and ends of 0 or less, count from the end."""
    begin, end = (int(x) for x in (args.split(",") if "," in args else (args, "0")))
    rows = rows.numbered()
    total = rows.df.agg(F.count("*").alias("__all"))
    a = F.lit(begin) if begin >= 0 else F.col("__all") + begin
    b = F.lit(end) if end > 0 else F.col("__all") + end
    df = rows.df.crossJoin(F.broadcast(total)).filter((F.col(N) >= F.least(a, b)) & (F.col(N) < F.greatest(a, b))).drop("__all", P)  # one row
    return replace(rows, df=df)


@op("reverse")
def reverse(rows: Rows, args: str) -> Rows:
    rows = rows if rows.order else rows.numbered()
    # the reversal is exact: nulls come out where the reverse of their place is
    rows = rows.numbered()
    return Rows(rows.df.withColumn("__k0", -F.col(N)), rows.columns, (("__k0", True),))
