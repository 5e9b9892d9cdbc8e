"""Data attachments: aggregates that tree nodes carry, and what a query reads from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import dates
from treeline.functions.anomalies import anomaly, options_of
from treeline.functions.sketches import bloom_share, bloom_size, count_min_count, in_bloom

TYPES: dict[str, Callable[[dict], Attachment]] = {}


@dataclass(frozen=True)
class Attachment:
    """``aggregates``: buffers by suffix, each from a wrapper that limits a value to the node's touches.
    ``value``: what ``$name=option`` reads from the buffers; ``nodes``: what ``%name=option`` lists.
    ``merges``: how buffers of two trees combine, where they can."""

    keys: dict[str, str]
    aggregates: Callable[[Callable[[Column], Column], Callable[[str], Column]], dict[str, Column]]
    value: Callable[[Callable[[str], Column], str], Column]
    nodes: Callable[[Callable[[str], Column], str], Column] | None = None
    merges: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    recent: int = 0  # if not 0, the tree adds a buffer ``recent``: the counts of the key's last so many whole numbers
    children: Callable[[DataFrame], DataFrame] | None = None  # from (path, name, hits) of all children, (path, children): few a node
    top: int = 0  # if not 0, the tree adds a buffer ``top``: so many most frequent values of the key, with their counts
    bloom: tuple[int, int | None, float] | None = None  # hashes, values and error: the tree adds a buffer ``bits``, a Bloom filter of the key
    distinct: str = ""  # if not empty, the tree adds a buffer of that name: how many different values the key has


def attachment(*names: str):
    def add(f):
        for n in names:
            TYPES[n] = TYPES[n.replace(".", "-")] = f
        return f

    return add


def made(spec: dict) -> Attachment:
    kind = spec["type"]
    if kind not in TYPES:
        raise ValueError(f"no attachment type {kind!r}")
    return TYPES[kind]({k: v for k, v in spec.items() if k != "type"})


def _long(c: Column) -> Column:
    return c.cast("string").try_cast("bigint")


def _pick(options: dict[str, Column], default: str) -> Callable[[str], Column]:
    def pick(option: str) -> Column:
        if (option or default) not in options:
            raise ValueError(f"no option {option!r}; there are {sorted(options)}")
        return options[option or default]

    return pick


@attachment("sum")
def _sum(o):
    length = o.get("base", 1) <= 0
    number = lambda k: F.length(k("key").cast("string")) if length else _long(k("key"))
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {"sum": F.sum(own(number(k))), "n": F.count(own(number(k)))},
        lambda b, x: _pick({"sum": F.coalesce(b("sum"), F.lit(0)), "num": b("n"), "count": b("n"), "avg": F.call_function("div", b("sum"), F.nullif(b("n"), F.lit(0)))}, "sum")(x),
        merges={"sum": F.sum, "n": F.sum},
    )


@attachment("sumf")
def _sum_float(o):
    number = lambda k: k("key").cast("string").try_cast("double")
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {"sum": F.sum(own(number(k))), "n": F.count(own(number(k)))},
        lambda b, x: _pick({"sum": F.coalesce(b("sum"), F.lit(0.0)), "count": b("n"), "avg": b("sum") / F.nullif(b("n"), F.lit(0))}, "sum")(x),
        merges={"sum": F.sum, "n": F.sum},
    )


@attachment("time")
def _time(o):
    at = lambda k: dates.read(k("key").cast("string"), o.get("format", "native"))
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {"first": F.min(own(at(k))), "last": F.max(own(at(k)))},
        lambda b, x: _pick({"first": b("first"), "last": b("last"), "life": b("last") - b("first")}, "life")(x),
        merges={"first": F.min, "last": F.max},
    )


@attachment("count")
def _count(o):
    """``ver: exact`` counts distinct values, apart from the other aggregates (Spark would keep the buffers of all of them for
    each value); otherwise a HyperLogLog sketch of 2**14 buckets estimates them."""
    text = lambda k: k("key").cast("string")
    if o.get("ver") == "exact":
        return Attachment({"key": o["key"]}, lambda own, k: {}, lambda b, x: b("n"), distinct="n")
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {"hll": F.hll_sketch_agg(own(text(k)), F.lit(14))},
        lambda b, x: F.hll_sketch_estimate(b("hll")),
        merges={"hll": F.hll_union_agg},
    )


@attachment("count.min.sketch")
def _count_min(o):
    """Estimated counts of a key's values: ``total``, and ``val(x)``; values as nodes ``%=a~b``."""
    sketch = lambda c: F.count_min_sketch(c, F.lit(float(o.get("error", 0.001))), F.lit(float(o.get("confidence", 0.99))), F.lit(1))
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {"cms": sketch(own(k("key").cast("string")))},
        lambda b, x: count_min_count(b("cms"), None if x in ("", "total") else x[4:-1]),
        lambda b, x: F.array(*[F.struct(F.lit(v).alias("name"), count_min_count(b("cms"), v).alias("hits")) for v in x.split("~")]),
    )


@attachment("key.top")
def _key_top(o):
    """The ``size`` most frequent values of a key, exact, ties by name: ``k1`` and ``v1`` the first value and its count,
    ``gKEY`` a value's count if it is among them, ``size``; as nodes all of them."""

    def value(b, x):
        if x in ("", "size"):
            return F.size(b("top")).cast("long")
        if x[0] in "kv" and x[1:].isdigit():
            at = F.get(b("top"), F.lit(int(x[1:]) - 1))
            return at["name"] if x[0] == "k" else at["hits"]
        return F.get(F.filter(b("top"), lambda v: v["name"] == x[1:]), F.lit(0))["hits"]

    return Attachment({"key": o["key"]}, lambda own, k: {}, value, lambda b, x: b("top"), top=int(o.get("size", 10)))


@attachment("copy", "map")
def _copy(o):
    """The last value of each key; the last is that of the greatest ``order`` (a field)."""
    fields = o["key"] if isinstance(o["key"], list) else [o["key"]]
    by = o.get("order")
    keys = {f"f{k}": f for k, f in enumerate(fields)} | ({"order": by} if by else {})

    def aggregates(own, k):
        at = k("order") if by else F.lit(1)
        return {f: F.max_by(own(k(f"f{n}")), F.when(own(k(f"f{n}")).isNotNull(), F.struct(at, k(f"f{n}")))) for n, f in enumerate(fields)}

    return Attachment(keys, aggregates, lambda b, x: F.coalesce(b(x.split(";")[0] or fields[0]).cast("string"), F.lit(x.split(";")[1] if ";" in x else None)))


@attachment("bits")
def _bits(o):
    size = int(o.get("size", 16))
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {str(n): F.sum(own(F.shiftright(_long(k("key")), n).bitwiseAND(1))) for n in range(size)},
        lambda b, x: F.coalesce(b(x or "0"), F.lit(0)),
        merges={str(n): F.sum for n in range(size)},
    )


@attachment("distribution")
def _distribution(o):
    """Approximate quantiles (median, 75 to 999) of a node's values; their mean, max, min and stdev."""
    share = {"median": 0.5, "75": 0.75, "95": 0.95, "98": 0.98, "99": 0.99, "999": 0.999}
    number = lambda k: k("key").cast("string").try_cast("double")

    def value(b, x):
        return F.get(b("q"), F.lit(list(share).index(x or "median"))) if (x or "median") in share else b(x)

    return Attachment({"key": o["key"]}, lambda own, k: {"q": F.percentile_approx(own(number(k)), list(share.values()), 10_000), "mean": F.avg(own(number(k))), "max": F.max(own(number(k))), "min": F.min(own(number(k))), "stdev": F.stddev(own(number(k)))}, value)


@attachment("tdigest")
def _tdigest(o):
    """Approximate quantiles in steps of 0.005: ``quantile(q)`` (.95); ``%=q1,q2`` as nodes."""
    number = lambda k: k("key").cast("string").try_cast("double")
    grid = [k / 200 for k in range(201)]
    at = lambda b, q: F.get(b("q"), F.lit(round(q * 200)))
    asked = lambda x: float(x[9:-1]) if x.startswith("quantile(") else float(x or 0.95)
    return Attachment(
        {"key": o["key"]},
        lambda own, k: {"q": F.percentile_approx(own(number(k)), grid, 10_000)},
        lambda b, x: at(b, asked(x)),
        lambda b, x: F.array(*[F.struct(F.lit(s).alias("name"), at(b, float(s)).cast("long").alias("hits")) for s in x.split(",")]),
    )


@attachment("bloom", "seen")
def _bloom(o):
    """A Bloom filter of a key, sized for ``max`` values with an ``error`` (0.01), at a node of more values for these; ``a~b`` tells whether all the values may be in it (1 or
    null), ``bits`` how many bits are set, ``sat`` their share in percent."""
    hashes = int(o.get("hash", 4))

    def value(b, x):
        if x == "bits":
            return bloom_size(b("bits"))
        if x == "sat":
            return bloom_share(b("bits"))
        test = F.lit(True)
        for v in x.split("~"):
            test = test & in_bloom(b("bits"), F.lit(v), hashes)
        return F.when(test, F.lit(1))

    return Attachment({"key": o["key"]}, lambda own, k: {}, value, bloom=(hashes, o.get("max"), float(o.get("error", 0.01))))


@attachment("histo")
def _histo(o):
    """Counts of the children's hits by powers of ``scale``; read with ``%name``."""
    scale = int(o.get("scale", 10))

    def powers(below: DataFrame) -> DataFrame:
        tier = F.pow(F.lit(scale), F.floor(F.log(F.col("hits").cast("double")) / F.log(F.lit(float(scale))) + 1e-9)).cast("long")
        counts = below.groupBy("path", tier.alias("tier")).agg(F.count("*").alias("hits"))
        listed = F.array_sort(F.collect_list(F.struct("tier", "hits")))
        return counts.groupBy("path").agg(F.transform(listed, lambda x: F.struct(x["tier"].cast("string").alias("name"), x["hits"].alias("hits"))).alias("children"))

    return Attachment({}, lambda own, k: {}, lambda b, x: F.size(b("children")).cast("long"), lambda b, x: b("children"), children=powers)


@attachment("top", "limit.top", "limit.hot")
def _top(o):
    """The children of the most hits, ties by name: ``size`` of them, as nodes. Ranks are cut before they are shuffled."""
    size = int(o.get("size", 10))

    def first(below: DataFrame) -> DataFrame:
        order = Window.partitionBy("path").orderBy(F.desc("hits"), "name")
        best = below.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size)
        listed = F.array_sort(F.collect_list(F.struct("r", "name", "hits")))
        return best.groupBy("path").agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["hits"].alias("hits"))).alias("children"))

    return Attachment({}, lambda own, k: {}, lambda b, x: F.get(b("children"), F.lit(0))["name"], lambda b, x: b("children"), children=first)


@attachment("reservoir")
def _reservoir(o):
    """Counts of the last ``size`` epochs. ``epoch||N~obs||N~mode||sigma~sigma||S`` (or ``mode||modelfit~percentile||P``) gives
    delta, measurement, mean, stddev, mode and percentile if the epoch stands out; ``%name=`` the counts as nodes."""
    size = int(o["size"])
    value = lambda b, x: anomaly(b("recent"), size, options_of(x, "||")) if x else F.size(b("recent")).cast("long")
    return Attachment({"key": o.get("epochField", o.get("key"))}, lambda own, k: {}, value, lambda b, x: b("recent"), recent=size)


#: Attachments whose values come from the children of a node rather than from rows.
OF_CHILDREN = {"histo", "top", "limit.top", "limit.hot", "limit-top", "limit-hot"}
NODE = T.StructType([T.StructField("name", T.StringType()), T.StructField("hits", T.LongType())])
