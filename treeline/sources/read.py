"""Sources: configurations to DataFrames, batch or streaming.

A source is {"type": name, ...}; an array of sources is concatenated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.hashing import in_shard
from treeline.plans.rows import Rows

SOURCES: dict[str, Callable[..., DataFrame]] = {}
LINES = ("column", "kv", "query", "regex", "noop")


def source(*names: str):
    def add(f):
        for n in names:
            SOURCES[n] = f
        return f

    return add


def read(spark: SparkSession, config: dict | list) -> DataFrame:
    if isinstance(config, list):
        config = {"type": "aggregate", "sources": config}
    if config["type"] not in SOURCES:
        raise ValueError(f"no source named {config['type']!r}")
    return SOURCES[config["type"]](spark, **{k: v for k, v in config.items() if k != "type"})


@source("aggregate")
def _aggregate(spark, sources):
    frames = [read(spark, s) for s in sources if s.get("enabled", True)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@source("const", "constant")
def _constant(spark, rows, schema=None, repeat=0):
    """Literal rows; ``repeat`` n gives them n + 1 times. Endless sources are streams: see ``rate``."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeat)))).drop("__r") if repeat else df


@source("empty")
def _empty(spark, maxPackets):  # noqa: N803
    return spark.range(maxPackets).select()


@source("rate")
def _rate(spark, rowsPerSecond=1):  # noqa: N803
    return spark.readStream.format("rate").option("rowsPerSecond", rowsPerSecond).load()


def dated(path: str, start: datetime | None = None, end: datetime | None = None, hours: bool = False) -> list[str]:
    """A path for each day (or hour) from start to end; {Y} {y} {M} {D} {H} and {{now-1}} are filled in."""
    path = re.sub(r"\{\{now([+-]\d+)?\}\}", lambda m: (datetime.now() + timedelta(days=int(m[1] or 0))).strftime("%y%m%d"), path)
    if start is None:
        return [path]
    out, at, step = [], start, timedelta(hours=1) if hours else timedelta(days=1)
    while at <= (end or start):
        out.append(path.replace("{Y}", at.strftime("%Y")).replace("{y}", at.strftime("%y")).replace("{M}", at.strftime("%m")).replace("{D}", at.strftime("%d")).replace("{H}", at.strftime("%H")))
        at += step
    return list(dict.fromkeys(out))


@source("files", "mesh2")
def _files(spark, files, format="parquet", schema=None, options=None, start=None, end=None, hours=False, stream=False, injectSourceName=None, shardTotal=None, shards=None):  # noqa: A002, N803
    """Files of a format, by date if the paths say so. Shards take the files of their numbers."""
    paths = [p for f in ([files] if isinstance(files, str) else files) for p in dated(f, start, end, hours)]
    reader = (spark.readStream if stream else spark.read).format("text" if format in LINES else format).options(**(options or {}) if format not in LINES else {})
    if schema and format not in LINES:
        reader = reader.schema(schema)
    df = reader.load(paths[0] if stream else paths)
    if injectSourceName:
        df = df.withColumn(injectSourceName, F.col("_metadata.file_path"))
    if shardTotal:
        df = df.filter(in_shard(F.col("_metadata.file_path"), shardTotal, shards))
    return bundled(df, format, **(options or {})) if format in LINES else df


def bundled(df: DataFrame, format: str, columns: list[str] | None = None, sep: str | None = None, pair: str = "=", text: str = "value", pattern: str | None = None, lineFilter=None) -> DataFrame:  # noqa: A002, N803
    """Lines to rows. ``column``: tokens in order, what is over goes; ``kv``: name=value pairs between &; ``query``: the
    same, decoded; ``regex``: the groups of a full match (named, or ``columns``), other lines go; ``noop``: the line."""
    if lineFilter is not None:
        from treeline.functions.value_filters import Value, filtered

        df = df.withColumn(text, filtered(Value(F.col(text)), lineFilter).c).filter(F.col(text).isNotNull())
    others = [F.col(c) for c in df.columns if c != text]
    line = F.col(text)
    if format == "noop":
        return df.select(line.alias(columns[0] if columns else text), *others)
    if format == "regex":
        names = columns or sorted(re.compile(re.sub(r"\(\?<(\w)", r"(?P<\1", pattern)).groupindex, key=lambda n: pattern.index(f"<{n}>"))
        whole = f"^(?:{re.sub(r'[(][?]P?<[A-Za-z]', lambda m: '(?<' + m[0][-1], pattern)})$"
        return df.filter(line.rlike(whole)).select(*[F.regexp_extract(line, whole, k + 1).alias(n) for k, n in enumerate(names)], *others)
    if format == "column":
        parts = F.split(line, "\\Q" + (sep or "\t") + "\\E")
        return df.select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)], *others)
    entries = F.filter(F.split(line, "\\Q" + (sep or "&") + "\\E"), lambda x: x != "")
    cut = lambda x: F.locate(pair, x)
    split = lambda x: F.struct(F.when(cut(x) > 0, F.substr(x, F.lit(1), cut(x) - 1)).otherwise(x).alias("k"), F.when(cut(x) > 0, F.substr(x, cut(x) + len(pair))).alias("v"))
    found = F.transform(entries, split)
    decoded = (lambda v: F.try_url_decode(v)) if format == "query" else (lambda v: v)
    if columns:  # the first pair of a name counts
        return df.select(*[decoded(F.get(_named(found, c), F.lit(0))["v"]).alias(c) for c in columns], *others)
    return df.select(F.transform(found, lambda e: F.struct(e["k"].alias("name"), decoded(e["v"]).alias("value"))).alias("fields"), *others)


def _named(pairs, name: str):
    return F.filter(pairs, lambda e: e["k"] == name)


@source("gson")
def _gson(spark, files, schema=None):
    """Files that hold an array of objects each; numbers are doubles."""
    df = spark.read.option("multiLine", True).option("prefersDecimal", False).json(files, schema=schema) if schema else spark.read.option("multiLine", True).json(files)
    return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind in ("bigint", "int")})


@source("json")
def _json(spark, files, schema=None):
    return spark.read.schema(schema).json(files) if schema else spark.read.json(files)


@source("avro")
def _avro(spark, files):
    return spark.read.format("avro").load(files)


@source("parquet")
def _parquet(spark, files):
    return spark.read.parquet(files)


@source("filter", "filtered")
def _filtered(spark, source, filter):  # noqa: A002
    from treeline.functions.bundle_filters import apply

    return apply(Rows.of(read(spark, source)), filter).plain()


@source("hashed")
def _hashed(spark, source, key, shardTotal, shards):  # noqa: N803
    """Rows whose key hashes to one of my shards. The hash is the 32-bit Murmur3 of the UTF-16 text."""
    return read(spark, source).filter(in_shard(F.coalesce(F.col(key).cast("string"), F.lit("")), shardTotal, shards))


@source("range")
def _range(spark, source, skip=0, limit=None):
    df = read(spark, source).offset(skip) if skip else read(spark, source)
    return df.limit(limit) if limit is not None else df


@source("sorted")
def _sorted(spark, source, fields, onField=None):  # noqa: N803
    df = read(spark, source)
    return df.orderBy(*fields) if onField is None else df.orderBy(onField, *fields)


@source("prefetch")
def _prefetch(spark, source):
    return read(spark, source)


@source("query")
def _query(spark, tree, path, ops=""):
    from treeline.plans.tree import query

    return query(tree, path, ops).plain()


@source("socket")
def _socket(spark, host, port):
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


@source("http")
def _http(spark, url, data=None, schema=None):
    """One request, made by the driver; its answer is JSON lines."""
    import urllib.request

    with urllib.request.urlopen(url, data.encode() if data else None) as answer:  # noqa: S310
        lines = answer.read().decode().splitlines()
    frame = spark.createDataFrame([(x,) for x in lines if x], T.StructType([T.StructField("value", T.StringType())]))
    return frame.select(F.from_json("value", schema).alias("v")).select("v.*") if schema else frame
