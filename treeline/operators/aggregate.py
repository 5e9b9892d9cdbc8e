"""Ops that gather rows: by key, by runs of equal keys, into tables, histograms and percentiles."""

from __future__ import annotations

import re
from dataclasses import replace
from urllib.parse import unquote

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.operators.registry import op
from treeline.plans.rows import N, P, Rows, islands, running

MOST_COLUMNS = 10_000


def _letters(spec: str) -> tuple[list[str], int]:
    """The letters of a spec, one a column, and the number in it (0: none)."""
    digits = "".join(re.findall(r"\d", spec))
    return list(re.sub(r"[\d,\s]", "", spec)), int(digits or 0)


def merging(rows: Rows, letter: str, ref: int) -> Column:
    """The aggregate of a letter over a column. What is null is left out, but counts for an average."""
    value, number = rows.col(ref), None
    if letter in "samMdp":
        number = rows.number(ref)
    floating = number is not None and isinstance(rows.kind(ref), (T.DoubleType, T.FloatType, T.DecimalType))
    at = F.col(N) if letter in "dlj" else None
    match letter:
        case "s":
            return F.sum(number)
        case "a":
            total = F.coalesce(F.sum(number), F.lit(0))
            return total / F.count("*") if floating else F.call_function("div", total, F.count("*"))
        case "m":
            return F.min(number)
        case "M":
            return F.max(number)
        case "p":
            return F.product(number)
        case "d":
            return 2 * F.min_by(number, F.when(number.isNotNull(), at)) - F.sum(number)
        case "j":
            pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(at.alias("n"), value.cast("string").alias("v")))))
            return F.array_join(F.transform(pairs, lambda x: x["v"]), ",")
        case "l":
            return F.max_by(value, F.when(value.isNotNull(), at))
        case "c":
            return F.approx_count_distinct(value.cast("string"), 0.01)
        case "C":
            return F.count_distinct(value)
    raise ValueError(f"no merge letter {letter!r}")


def _merged(rows: Rows, spec: str, extra_keys: list[str]) -> tuple[Rows, int, str | None]:
    letters, number = _letters(spec)
    if any(x in "dlj" for x in letters) and N not in rows.df.columns:
        rows = rows.numbered()
    keys, aggregates, visible, top, column = [], [], [], None, 0
    marked = False
    for letter in letters:
        if letter == "t":
            marked = True
        elif letter == "u":
            visible.append(rows.fresh("rows"))
            aggregates.append(F.count("*").alias(visible[-1]))
        else:
            name = rows.name(column)
            if letter == "k":
                keys.append(F.coalesce(rows.col(column), F.lit("")).alias(name) if isinstance(rows.kind(column), T.StringType) else rows.col(column).alias(name))
                visible.append(name)
            elif letter != "i":
                aggregates.append(merging(rows, letter, column).alias(name))
                visible.append(name)
            if marked:
                top, marked = name, False
            column += 1
    if marked and visible:
        top = visible[-1]
    df = rows.df.groupBy(*keys, *[F.col(k) for k in extra_keys])
    df = df.agg(*aggregates) if aggregates else df.agg(F.count("*").alias("__rows"))
    return Rows(df.select(*visible, *extra_keys), tuple(visible)), number, top


@op("gather", "top")
def gather(rows: Rows, spec: str) -> Rows:
    """One letter a column: k key, s sum, a average, m least, M greatest, d first less the others, p product,
    j joined by commas, l last, c distinct (estimate), C distinct (exact), i ignored, u adds the number of rows.
    ``t`` and a number keep the rows of the greatest values of the column after it (ties: smaller keys first)."""
    letters, number = _letters(spec)
    if spec[:1].isdigit() and "," in spec:
        spec = spec.partition(",")[2]
    merged, _, top = _merged(rows, spec, [])
    if number and "t" in letters:
        if top is None:
            raise ValueError("t needs a column after it")
        key = merged.number(top)
        others = [c for c in merged.columns if c != top]
        df = merged.df.orderBy(key.desc_nulls_last(), *[F.col(f"`{c}`") for c in others]).limit(number)
        return Rows(df, merged.columns)
    return merged


@op("merge")
def merge(rows: Rows, spec: str) -> Rows:
    """As ``gather``, for runs of equal keys only; a number at the end closes a run after so many rows."""
    letters, number = _letters(spec)
    keys = [rows.col(k) for k, x in enumerate([x for x in letters if x not in "tu"]) if x == "k"]
    rows = islands(rows, keys)
    extra = ["__island"]
    if number:
        place = F.row_number().over(Window.partitionBy("__island").orderBy(N)) - 1
        rows = replace(rows, df=rows.df.withColumn("__chunk", F.floor(place / number)))
        extra.append("__chunk")
    merged, _, _ = _merged(rows, re.sub(r"\d", "", spec), extra)
    df = merged.df.withColumnsRenamed({e: f"__k{k}" for k, e in enumerate(extra)})
    return Rows(df, merged.columns, tuple((f"__k{k}", True) for k in range(len(extra))))


#: Ops that look at one row only: under ``groupby`` they do what they do without.
ROW_OPS = {"order", "ordermap", "map", "rmap", "compare", "contains", "filter", "num", "math", "str", "datef", "fill", "pad"}


def _group_keys(rows: Rows, text: str) -> list[str]:
    """Column references, or a letter for each column (k: key)."""
    refs = text.split(",")
    if all(rows.has(r) for r in refs):
        return [rows.name(r) for r in refs]
    return [rows.name(k) for k, letter in enumerate(_letters(text)[0]) if letter == "k"]


@op("groupby")
def group_by(rows: Rows, args: str) -> Rows:
    """``keys:ops``: a pipeline for each key; keys are columns, or letters as in ``gather``. Rows keep their order; in the
    arguments ``%3B`` stands for the ``;`` between ops."""
    from treeline.operators.registry import run, split_ops

    text, _, sub = args.partition(":")
    keys = _group_keys(rows, text)
    for name, given in split_ops(unquote(sub)):
        if name in ("limit", "skip", "range", "reverse", "median"):
            rows = _placed_in_groups(rows, keys, name, given)
        elif name in ("sort", "dsort") or name in ROW_OPS:
            rows = run(rows, f"{name}={given}")
        elif name in ("min", "max", "sum", "avg", "delta") and not re.match("[if]?S", given):
            rows = _running_in_groups(rows, keys, name, given)
        elif name in ("gather", "top"):
            letters = iter(_letters(given)[0])
            spec = "".join("k" if c in keys else next(letters, "i") for c in rows.columns)
            rows = run(rows, f"gather={spec}{''.join(x for x in letters if x == 'u')}")
        else:
            raise ValueError(f"groupby can't run {name!r}")
    return rows


def _placed_in_groups(rows: Rows, keys: list[str], name: str, given: str) -> Rows:
    """Ops that go by a row's place, with the place within its group (from 0)."""
    rows = rows if rows.order else rows.numbered()
    group = Window.partitionBy(*keys)
    place, size = F.row_number().over(group.orderBy(*rows.sort_keys())) - 1, F.count("*").over(group)
    if name == "reverse":
        back = replace(rows, df=rows.df.withColumn("__place", size - place))
        return replace(back, df=back.df.withColumn("__k_back", F.col("__place")).drop("__place"), order=(("__k_back", True),))
    rows = replace(rows, df=rows.df.withColumns({"__place": place, "__size": size}))
    at = F.col("__place")
    if name == "limit":
        skip, n = [int(x) for x in given.split(":")] if ":" in given else (0, int(given))
        kept = at.between(skip, skip + n - 1)
    elif name == "median":
        kept = at == F.expr("__size div 2")
    elif name == "skip":
        kept = at >= int(given.split(",")[0])
    else:
        begin, end = ([int(x) for x in given.split(",")] + [None])[:2]
        whole = lambda x: F.lit(x) if x >= 0 else F.col("__size") + x
        kept = (at >= whole(begin)) & (at < whole(end)) if end is not None else at >= whole(begin)
    return replace(rows, df=rows.df.filter(kept).drop("__place", "__size", P))


def _running_in_groups(rows: Rows, keys: list[str], name: str, given: str) -> Rows:
    """Running values that begin anew with each group, whether its rows stand together or not."""
    from treeline.operators.registry import run

    rows = rows.numbered()
    together = replace(rows.sorted_by([(rows.col(k), True) for k in keys]))
    place = rows.fresh("__came")
    together = Rows(together.df.withColumn(place, F.col(together.hidden[-1])), (*rows.columns, place), together.order)
    done = run(together, f"{name}={given}:{','.join(keys)}")
    visible = tuple(c for c in done.columns if c != place)
    return Rows(done.df.select(*[F.col(f"`{c}`") for c in visible], F.col(place).alias("__k0")), visible, (("__k0", True),))


@op("fold")
def fold(rows: Rows, args: str) -> Rows:
    """``keys:column:values:copied``: a run of equal keys becomes one row with a column for each value and copied column."""
    keys, column, values, copied = (x.split(",") for x in args.split(":"))
    keys, column, copied = [rows.name(k) for k in keys], rows.name(column[0]), [rows.name(c) for c in copied]
    rows = islands(rows, [rows.col(k) for k in keys])
    cells = {f"{v}_{c}": F.max_by(rows.col(c), F.when(rows.col(column).cast("string") == v, F.col(N))) for v in values for c in copied}
    df = rows.df.groupBy("__island", *keys).agg(*[c.alias(n) for n, c in cells.items()]).withColumnRenamed("__island", "__k0")
    return Rows(df, (*keys, *cells), (("__k0", True),))


_CELLS = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "first": F.first}


@op("pivot")
def pivot(rows: Rows, args: str) -> Rows:
    """``rowkeys,column,cell[,cellop[,rowop[,colop]]]``: a column for each value of ``column``, rows sorted by label;
    ``rowop`` adds a column over a row's cells, ``colop`` a last row over each column."""
    parts = args.split(",")
    row, column, cell, cell_op, row_op, col_op = (parts + [""] * 6)[:6]
    keys = [rows.name(k) for k in row.split(":")]
    by, number = rows.name(column), rows.number(cell)
    labels = [r[0] for r in rows.df.select(F.col(f"`{by}`").cast("string")).distinct().orderBy(F.col(by).asc_nulls_first()).limit(MOST_COLUMNS + 1).collect()]
    if len(labels) > MOST_COLUMNS:
        raise ValueError(f"pivot: more than {MOST_COLUMNS} columns")
    labels = [x for x in labels if x is not None]
    df = rows.df.withColumn("__by", F.col(f"`{by}`").cast("string")).groupBy(*[F.col(f"`{k}`") for k in keys]).pivot("__by", labels).agg(_CELLS[cell_op or "sum"](number))
    if row_op or col_op:
        df = df.fillna(0, subset=labels)
    across = {"sum": lambda cs: sum(cs[1:], cs[0]), "min": lambda cs: F.least(*cs) if len(cs) > 1 else cs[0], "max": lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0], "avg": lambda cs: sum(cs[1:], cs[0]) / len(cs)}
    if row_op and labels:
        df = df.withColumn(f"__{row_op}__", across[row_op]([F.col(f"`{x}`") for x in labels]))
    columns = df.columns
    df = df.withColumn("__k0", F.lit(0))
    if col_op:
        numbers = [c for c in columns if c not in keys]
        foot = df.agg(*[_CELLS[col_op](f"`{c}`").alias(c) for c in numbers]).select(*[F.lit(f"__{col_op}__" if k == 0 else None).cast("string").alias(c) for k, c in enumerate(keys)], *[F.col(f"`{c}`") for c in numbers], F.lit(1).alias("__k0"))
        df = df.withColumns({k: F.col(f"`{k}`").cast("string") for k in keys}).unionByName(foot)
    df = df.withColumns({f"__k{n + 1}": F.col(f"`{k}`") for n, k in enumerate(keys)})
    return Rows(df, tuple(columns), tuple((f"__k{n}", True) for n in range(len(keys) + 1)))


@op("depivot")
def depivot(rows: Rows, args: str) -> Rows:
    """``row,column,value[,extra..]``: names of the new columns. The first row is the header: its cells label the columns that
    become rows; the first column labels the rows. Columns without a label are dropped, but for one, from the left, for each
    ``extra``, which each new row gets. With ``names:`` before the arguments the columns' own names are the labels, and there is no header row."""
    named = args.startswith("names:")
    row, column, value, *extra = [*(args.removeprefix("names:").split(",") if args else []), *["row", "column", "value"][args.count(",") + 1 if args else 0 :]]
    rows = rows.numbered()
    label, others = rows.columns[0], rows.columns[1:]
    if named:
        labels = dict(zip(others, others, strict=True))
    else:
        head = rows.df.filter(F.col(N) == 0).select(*[rows.col(c).cast("string").alias(c) for c in others]).collect()  # one row
        labels = {c: head[0][c] if head else None for c in others}
        rows = rows.filter(F.col(N) > 0)
    more = [c for c in others if labels[c] is None][: len(extra)]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(labels[c]).alias("c"), rows.col(c).cast("string").alias("v")) for k, c in enumerate(c for c in others if labels[c] is not None)])
    if all(v is None for v in labels.values()):
        pairs = F.array().cast("array<struct<k int, c string, v string>>")
    df = rows.df.select(rows.col(label).alias(row), *[rows.col(c).alias(n) for c, n in zip(more, extra, strict=False)], F.explode(pairs).alias("x"), F.col(N).alias("__k0"))
    visible = (row, column, value, *extra[: len(more)])
    df = df.select(row, F.col("x.c").alias(column), F.col("x.v").alias(value), *extra[: len(more)], "__k0", F.col("x.k").alias("__k1"))
    return Rows(df, visible, (("__k0", True), ("__k1", True)))


@op("trans", "t")
def transpose(rows: Rows, args: str) -> Rows:
    """Rows become columns. A table of more than ``MOST_COLUMNS`` rows is refused."""
    rows = rows.numbered()
    count = rows.df.limit(MOST_COLUMNS + 1).count()
    if count > MOST_COLUMNS:
        raise ValueError(f"trans: more than {MOST_COLUMNS} rows")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), rows.col(c).cast("string").alias("v")) for k, c in enumerate(rows.columns)])
    df = rows.df.select(N, F.explode(cells).alias("x")).groupBy(F.col("x.k").alias("__k0")).pivot(N, list(range(count))).agg(F.first("x.v"))
    names = {str(k): f"c{k}" for k in range(count)}
    return Rows(df.withColumnsRenamed(names), tuple(names.values()), (("__k0", True),))


@op("ftable")
def frequency_table(rows: Rows, args: str) -> Rows:
    """``keys:value,frequency:shares``: for runs of equal keys, the first value whose cumulative frequency reaches
    round(share * total); a share ``total`` gives the total."""
    keys, pair, shares = args.split(":")
    keys = [rows.name(k) for k in keys.split(",")]
    value, frequency = pair.split(",")
    rows = islands(rows, [rows.col(k) for k in keys])
    v, f = rows.number(value), rows.number(frequency)
    df = rows.df.withColumns({"__v": v, "__f": f})
    df = df.groupBy("__island", *keys, "__v").agg(F.sum("__f").alias("__f"))
    whole = Window.partitionBy("__island")
    df = df.withColumns({"__c": F.sum("__f").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum("__f").over(whole)})
    named = {}
    for s in shares.split(","):
        named[f"p{s}" if s != "total" else s] = F.max("__t") if s == "total" else F.min(F.when(F.col("__c") >= F.round(F.col("__t") * float(s)), F.col("__v")))
    df = df.groupBy("__island", *keys).agg(*[c.alias(n) for n, c in named.items()]).withColumnRenamed("__island", "__k0")
    return Rows(df, (*keys, *named), (("__k0", True),))


@op("histo")
def histogram(rows: Rows, args: str) -> Rows:
    """``column[,scale]``: counts by powers of the scale (10): the greatest power not above the value; negatives
    count with 1, zeros and nulls don't count."""
    ref, _, scale = args.partition(",")
    scale = int(scale or 10)
    v = rows.number(ref, "bigint")
    bucket = F.lit(1).cast("bigint")
    power = scale
    while power < 1 << 63:
        bucket = F.when(v >= power, F.lit(power).cast("bigint")).otherwise(bucket)
        power *= scale
    df = rows.df.filter(v != 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))
    return Rows.of(df, "bucket")


@op("histo2")
def histogram_of_bounds(rows: Rows, args: str) -> Rows:
    """``column[:frequency],b1,b2..``: counts between bounds, all buckets, the first from the least number on."""
    ref, *bounds = args.split(",")
    ref, _, frequency = ref.partition(":")
    floating = any("." in b for b in bounds)
    limits = sorted(float(b) if floating else int(b) for b in bounds)
    limits = [float("-inf") if floating else -(1 << 31), *limits]  # the least number of 32 bits
    kind = "double" if floating else "bigint"
    v = rows.number(ref, kind)
    bucket = F.lit(limits[0]).cast(kind)
    for b in limits[1:]:
        bucket = F.when(v >= b, F.lit(b).cast(kind)).otherwise(bucket)
    weight = rows.number(frequency, "bigint") if frequency else F.lit(1)
    counts = rows.df.filter(v.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.sum(weight).alias("n"))
    every = rows.df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b).cast(kind) for b in limits])).alias("bucket"))
    df = every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    return Rows.of(df, "bucket")


QUANTILES = (0.5, 0.75, 0.95, 0.98, 0.99, 0.999)


def quantiles(rows: Rows, ref: str, shares: tuple[float, ...] = QUANTILES) -> Rows:
    """quantile, value: exact, at place q * (n + 1) of the sorted values, between two by their distance."""
    v = rows.number(ref)
    placed = rows.select({"v": v}).filter(F.col("v").isNotNull()).sorted_by([(F.col("v"), True)]).numbered()
    total = placed.df.agg(F.count("*").alias("n"))
    asked = placed.df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("quantile")).crossJoin(F.broadcast(total)).filter("n > 0")  # one row for each share
    place = F.greatest(F.least(F.col("quantile") * (F.col("n") + 1), F.col("n").cast("double")), F.lit(1.0))
    asked = asked.withColumn("low", F.floor(place)).withColumn("part", place - F.col("low")).withColumn("high", F.least(F.col("low") + 1, F.col("n")))
    needed = placed.df.join(F.broadcast(asked.select(F.explode(F.array("low", "high")).alias("at")).distinct()), F.col(N) + 1 == F.col("at"), "left_semi").select((F.col(N) + 1).alias("at"), F.col("v").cast("double").alias("v"))
    df = asked.join(needed.withColumnsRenamed({"at": "low", "v": "a"}), "low").join(needed.withColumnsRenamed({"at": "high", "v": "b"}), "high")
    return Rows.of(df.select("quantile", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value")), "quantile")


@op("distribution")
def distribution(rows: Rows, args: str) -> Rows:
    """``column``: the .5, .75, .95, .98, .99 and .999 quantiles, over all rows."""
    return quantiles(rows, args.split(",")[0])


@op("percentrank")
def percent_rank(rows: Rows, args: str) -> Rows:
    """``in:out``: (1 + place of the first equal value) / rows. What is no number goes."""
    source, _, target = args.partition(":")
    v = rows.number(source)
    rows = replace(rows, df=rows.df.withColumn("__v", v).filter("__v IS NOT NULL"))
    counts = rows.df.groupBy(F.col("__v").alias("value")).agg(F.count("*").alias("n"))
    placed = running(Rows.of(counts, "value"), "until", F.col("n"), "sum")
    total = rows.df.agg(F.count("*").alias("all"))  # one row
    ranks = placed.df.crossJoin(F.broadcast(total)).select(F.col("value").alias("__v"), ((1 + F.col("until") - F.col("n")) / F.col("all")).alias("__r"))
    rows = replace(rows, df=rows.df.join(ranks, "__v").drop("__v")).with_column(target if target else "rank", F.col("__r"))
    return replace(rows, df=rows.df.drop("__r"))


@op("median")
def median(rows: Rows, args: str) -> Rows:
    """The middle row."""
    rows = rows.numbered()
    total = rows.df.agg(F.count("*").alias("__all"))
    df = rows.df.join(F.broadcast(total), F.col(N) == F.expr("__all div 2"), "left_semi").drop(P)
    return Rows(df, rows.columns, rows.order)


@op("disorder")
def disorder(rows: Rows, args: str) -> Rows:
    """``primary:secondary[:frequency]``: entropy (log10) and Gini impurity of the secondary within each primary."""
    primary, secondary, *frequency = args.split(":")
    p, weight = rows.name(primary), rows.number(frequency[0]) if frequency else F.lit(1)
    counts = rows.df.groupBy(p, rows.col(secondary).alias("__s")).agg(F.sum(weight).alias("__n"))
    # sums of n and of n log n need no total first
    df = counts.groupBy(p).agg(F.sum("__n").alias("t"), F.sum(F.col("__n") * F.log10("__n")).alias("nl"), F.sum(F.col("__n").cast("double") * F.col("__n")).alias("nn"))
    df = df.select(p, (F.log10("t") - F.col("nl") / F.col("t")).alias("entropy"), (1 - F.col("nn") / (F.col("t").cast("double") * F.col("t"))).alias("gini"))
    return Rows.of(df, p)


@op("rmsing")
def remove_singletons(rows: Rows, args: str) -> Rows:
    """``key:value``: runs of equal keys with more than one distinct value."""
    key, value = args.split(":")
    rows = islands(rows, [rows.col(key)])
    v = rows.col(value)
    kept = rows.df.groupBy("__island").agg(F.min(v).alias("a"), F.max(v).alias("b")).filter("a <> b").select("__island")
    return Rows(rows.df.join(kept, "__island", "left_semi").drop(P), rows.columns, rows.order)


@op("seen")
def seen(rows: Rows, args: str) -> Rows:
    """``column[,hashes[,max[,error]]]``: one row with a Bloom filter of the column, sized for ``max`` values, or for all if there are more."""
    from treeline.functions.sketches import bloom_bytes, bloom_filters, empty_bloom

    ref, hashes, most, error = (args.split(",") + ["", "", ""])[:4]
    sizing = int(hashes or 4), int(most or 0), float(error or 0.01)
    pairs = rows.df.select(F.lit(0).alias("path"), rows.col(ref).cast("string").alias("name")).filter("name IS NOT NULL").distinct()
    one = rows.df.sparkSession.range(1).select(F.lit(0).alias("path"))
    return Rows(one.join(bloom_filters(pairs, "bloom", *sizing), "path", "left").select(bloom_bytes(F.coalesce("bloom", empty_bloom(*sizing))).alias("bloom")), ("bloom",))
