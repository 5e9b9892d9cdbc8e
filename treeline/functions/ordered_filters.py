"""Value filters whose result depends on the rows before: counters, serial numbers, bands of occurrences."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from treeline.plans.rows import N, P, Rows

ORDERED = {"count", "serial", "band-pass", "key-sieve", "key-sieve2", "limit-upper"}


def occurrence(rows: Rows, value: Column) -> tuple[Rows, Column]:
    """How many earlier rows have the same value. Each partition counts its own; what earlier partitions hold is
    joined by (value, partition), so a frequent value is spread over partitions."""
    rows = rows.numbered()
    df = rows.df.withColumn("__o", value)
    counts = df.filter("__o IS NOT NULL").groupBy("__o", P).agg(F.count("*").alias("__n_here"))
    earlier = Window.partitionBy("__o").orderBy(P).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__earlier", F.coalesce(F.sum("__n_here").over(earlier), F.lit(0))).drop("__n_here")
    own = F.row_number().over(Window.partitionBy(P, "__o").orderBy(N)) - 1
    df = df.withColumn("__own", own).join(counts, ["__o", P], "left").withColumn("__seen", F.col("__own") + F.col("__earlier"))
    return replace(rows, df=df.drop("__o", "__own", "__earlier")), F.col("__seen")


def ordered(rows: Rows, field: str, spec: dict) -> tuple[Rows, Column]:
    """``rows`` (numbered), and the filter's result for a field."""
    o = {k: v for k, v in spec.items() if k != "op"}
    rows = rows.numbered()
    if spec["op"] == "count":
        n = F.lit(o.get("start", 0)) + F.lit(o.get("increment", 1)) * F.col(N)
        shown = F.lpad(n.cast("string"), len(o["format"]), "0") if re.fullmatch("0+", o.get("format") or "") else n
        if o.get("sample"):
            return rows, F.when(n % o["sample"] == 0, shown if o.get("format") else rows.col(field))
        return rows, shown
    if spec["op"] == "serial":
        n = F.lit(o.get("seed", 0)) + 1 + F.col(N)
        n = n % o["mod"] if o.get("mod") else n
        n = n - n % o["round"] if o.get("round") else n
        text = F.lower(F.conv(n.cast("string"), 10, o.get("base") or 10))
        return rows, F.concat(F.lit(o.get("prefix", "")), text)
    value = rows.col(field)
    rows, seen = occurrence(rows, value.cast("string"))
    if spec["op"] == "band-pass":
        least, most = o.get("minHits", 0), o.get("maxHits", 0)
    elif spec["op"] == "limit-upper":  # the first so many of each value; with ``upper`` false all but those
        least, most = (0, o["limit"]) if o.get("upper", True) else (o["limit"], 0)
    else:
        least, most = o.get("tiers", 1), 0
    keep = (seen >= least) if least else F.lit(True)
    keep = keep & (seen < most) if most else keep
    keep = keep | value.cast("string").isin(o["whitelist"]) if o.get("whitelist") else keep
    return rows, F.when(keep, value)
