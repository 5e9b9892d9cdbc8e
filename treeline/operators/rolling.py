"""Ops over rows in order: running values, differences, repeats."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeline.operators.registry import op
from treeline.plans.rows import N, Rows, islands, lagged, running


def _arguments(args: str) -> tuple[str, bool, bool, list[str], list[str]]:
    """Type (i, f or none), in place, summary row, columns, keys."""
    columns, _, keys = args.partition(":")
    kind = columns[0] if columns[:1] in ("i", "f") and columns[1:2] in ("s", "S", "c", *"0123456789") else ""
    columns = columns[len(kind) :]
    mark = columns[0] if columns[:1] in ("s", "S") and columns[1:2].isdigit() else ""
    return kind, mark == "s", mark == "S", columns[len(mark) :].split(","), keys.split(",") if keys else []


def _rolled(rows: Rows, args: str, how: str) -> Rows:
    kind, in_place, summary, refs, keys = _arguments(args)
    rows = islands(rows, [rows.col(k) for k in keys]) if keys else rows.numbered()
    names = [rows.name(r) for r in refs]
    force = {"i": "bigint", "f": "double", "": ""}[kind]
    values = {n: rows.number(n, force) for n in names}
    out = {n: n if in_place else f"{how}_{n}" for n in names}
    visible, order = rows.columns, rows.order
    along = Window.partitionBy("__island").orderBy(N).rowsBetween(Window.unboundedPreceding, 0) if keys else None
    if how == "delta":
        if keys:
            step = Window.partitionBy("__island").orderBy(N)
            df = rows.df.withColumns({f"__d{n}": v - F.coalesce(F.lag(v).over(step), F.lit(0)) for n, v in values.items()})
        else:
            rows = lagged(rows, {f"__v{k}": v for k, v in enumerate(values.values())})
            df = rows.df.withColumns({f"__d{n}": v - F.coalesce(F.col(f"__v{k}"), F.lit(0)) for k, (n, v) in enumerate(values.items())})
    else:
        base = "sum" if how == "avg" else how
        if keys:
            f = {"sum": lambda v: F.coalesce(F.sum(v).over(along), F.lit(0)), "min": lambda v: F.min(v).over(along), "max": lambda v: F.max(v).over(along)}[base]
            df = rows.df.withColumns({f"__d{n}": f(v) for n, v in values.items()} | {"__c": F.row_number().over(Window.partitionBy("__island").orderBy(N))})
        else:
            for n, v in values.items():
                rows = running(rows, f"__d{n}", v, base)
            df = rows.df.withColumn("__c", F.col(N) + 1)
        if how == "avg":
            df = df.withColumns({f"__d{n}": F.col(f"__d{n}") / F.col("__c") if kind == "f" or dict(df.dtypes)[f"__d{n}"] == "double" else F.call_function("div", F.col(f"__d{n}"), F.col("__c").cast("bigint")) for n in names})
    if summary:
        last = df.withColumn("__last", F.col(N)).groupBy().agg(F.max_by(F.struct(*[F.col(f"__d{n}") for n in names]), "__last").alias("x"), (F.max("__last") + 1).alias(N))
        df = df.select(*[F.col(f"`{c}`") for c in visible], N)
        foot = last.filter(F.col(N).isNotNull()).select(*[(F.col(f"x.__d{c}") if c in names else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in visible], N)
        return Rows(df.unionByName(foot), visible, ((N, True),))
    df = df.withColumns({out[n]: F.col(f"__d{n}") for n in names})
    return Rows(df, visible if in_place else (*visible, *[o for o in out.values() if o not in visible]), order)


for _how in ("min", "max", "sum", "avg", "delta"):
    op(_how)(lambda rows, args, how=_how: _rolled(rows, args, how))


@op("nodup")
def no_repeats(rows: Rows, args: str) -> Rows:
    """Cells equal to the cell above become null."""
    names = [rows.name(r) for r in args.split(",")] if args else list(rows.columns)
    rows = lagged(rows, {f"__v{k}": rows.col(n) for k, n in enumerate(names)})
    same = {n: F.when(rows.col(n).eqNullSafe(F.col(f"__v{k}")) & ~F.col("__first"), None).otherwise(rows.col(n)) for k, n in enumerate(names)}
    return replace(rows, df=rows.df.withColumns(same).drop("__first", *[f"__v{k}" for k in range(len(names))]))
