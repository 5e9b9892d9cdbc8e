"""Sinks: where rows go."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINKS: dict[str, Callable[..., None]] = {}


def sink(*names: str):
    def add(f):
        for n in names:
            SINKS[n] = f
        return f

    return add


def write(df: DataFrame, config: dict) -> None:
    if config["type"] not in SINKS:
        raise ValueError(f"no sink named {config['type']!r}")
    SINKS[config["type"]](df, **{k: v for k, v in config.items() if k != "type"})


@sink("file", "files")
def _file(df, path, format="parquet", partitionBy=None, mode="overwrite", options=None, maxRecords=0):  # noqa: A002, N803
    """Files of a format; ``partitionBy``: a folder for each value. No file holds more than ``maxRecords`` rows. Fields in
    the path, such as ``out/{{day}}/{{host}}``, are folders by value, too: what stands before the first is the path."""
    if fields := re.findall(r"\{\{(\w+)\}\}", path):
        path, partitionBy = path.partition("{{")[0].rpartition("/")[0], [*fields, *(partitionBy or [])]  # noqa: N806
    if format == "column":
        options, format = {"sep": "\t"} | (options or {}), "csv"  # noqa: A001
    w = df.write.mode(mode).format(format).options(**(options or {}))
    w = w.option("maxRecordsPerFile", maxRecords) if maxRecords else w
    (w.partitionBy(*partitionBy) if partitionBy else w).save(path)


@sink("default")
def _default(df, path):
    df.write.mode("overwrite").json(path)


@sink("filtered")
def _filtered(df, filter, output):  # noqa: A002
    from treeline.functions.bundle_filters import apply
    from treeline.plans.rows import Rows

    write(apply(Rows.of(df), filter).plain(), output)


@sink("chain", "multi", "outputs")
def _multi(df, outputs):
    for o in outputs:
        write(df, o)


@sink("tree")
def _tree(df, path, elements):
    """A tree's node table as Parquet, dealt by depth."""
    from treeline.plans.tree import built

    built(df, elements).nodes.write.mode("overwrite").partitionBy("depth").parquet(path)


@sink("key-value")
def _key_value(df, path, key, value):
    """The last row of each key by ``value``'s order, as a table of key and value."""
    df.groupBy(key).agg(F.max(value).alias(value)).write.mode("overwrite").parquet(path)


@sink("empty", "noop")
def _noop(df):
    df.write.format("noop").mode("overwrite").save()


@sink("http")
def _http(df, url, batchSize=1000, retries=3):  # noqa: N803
    """JSON lines, POSTed in batches by the tasks."""
    lines = df.select(F.to_json(F.struct("*")).alias("line"))

    def post(rows) -> None:
        import time
        import urllib.request

        def send(batch: list[str]) -> None:
            for k in range(retries):
                try:
                    urllib.request.urlopen(urllib.request.Request(url, "\n".join(batch).encode(), {"Content-Type": "application/json"}), timeout=60).close()  # noqa: S310
                    return
                except OSError:
                    if k == retries - 1:
                        raise
                    time.sleep(2**k)

        batch: list[str] = []
        for r in rows:
            batch.append(r[0])
            if len(batch) >= batchSize:
                send(batch)
                batch = []
        if batch:
            send(batch)

    lines.foreachPartition(post)


def encoded(df: DataFrame, format: str = "csv2", header: bool = False) -> DataFrame:  # noqa: A002
    """Rows as lines of text: ``json``, or ``csv2``, ``psv2``, ``tsv2`` (comma, bar, tab; texts that hold the delimiter, a
    quote or a line break stand in quotes, quotes doubled; nulls are empty), or ``html`` (the rows of a table, markup
    escaped, nulls as ``null``). One column, ``value``."""
    if format == "html":

        def data(c: str):
            text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))
            for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                text = F.replace(text, F.lit(sign), F.lit(name))
            return F.concat(F.lit("<td>"), text, F.lit("</td>"))

        rows = df.select(F.concat(F.lit("<tr>"), *[data(c) for c in df.columns], F.lit("</tr>")).alias("value"))
        one = df.sparkSession.range(1)
        head, tail = (one.select(F.lit(x).alias("value")) for x in ("<table border=1 cellpadding=1 cellspacing=0>", "</table>"))
        return head.unionByName(rows).unionByName(tail) if header else rows
    if format == "json":
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    by = {"csv2": ",", "psv2": "|", "tsv2": "\t"}[format]

    def cell(c: str):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.contains(by) | text.contains('"') | text.contains("\n"), quoted).otherwise(text)

    lines = df.select(F.concat_ws(by, *[cell(c) for c in df.columns]).alias("value"))
    if not header:
        return lines
    return df.sparkSession.range(1).select(F.lit(by.join(df.columns)).alias("value")).unionByName(lines)
