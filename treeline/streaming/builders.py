"""Stream builders: rows from rows. All work on batch and, but for ``join`` and ``sort_dedupe``, streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def each(df: DataFrame, array: str, to: str | None = None) -> DataFrame:
    """A row for each element of an array."""
    return df.withColumn("__x", F.explode(F.col(array))).withColumn(to or array, F.col("__x")).drop("__x")


def row_splitter(df: DataFrame, array: str, to: str) -> DataFrame:
    """A row for each element of an array, and the row itself, where ``to`` is null."""
    kind = df.schema[array].dataType.elementType
    items = F.concat(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType)), F.array(F.lit(None).cast(kind)))
    return df.withColumn(to, F.explode(items))


def map_splitter(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row for each entry of a map."""
    others = [F.col(c) for c in df.columns if c != column]
    return df.select(*others, F.explode(F.col(column)).alias(key, value))


def repeat(df: DataFrame, times: str | int) -> DataFrame:
    """Copies of each row; ``times`` is a number or a column."""
    n = F.col(times).cast("int") if isinstance(times, str) else F.lit(times)
    return df.filter(n > 0).withColumn("__x", F.explode(F.sequence(F.lit(1), n))).drop("__x")


def chain(df: DataFrame, builders: list) -> DataFrame:
    """Every builder gets the same rows; their results are put together."""
    out = builders[0](df)
    for b in builders[1:]:
        out = out.unionByName(b(df), allowMissingColumns=True)
    return out


def join(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of one key become one row, once all fields are there."""
    merged = df.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
    return merged.dropna(subset=fields)


def sort_dedupe(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row (by ``order``) of each key, sorted by key."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r").orderBy(key)
