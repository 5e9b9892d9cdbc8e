"""Ordered rows: a DataFrame, its visible columns, and the order that order-dependent ops see.

The order is a list of hidden sort keys. Ops that need a row's place or its neighbour call ``numbered``,
which sorts by range, numbers the rows of each partition, and adds the partition's offset: one shuffle, no
single task that sees all rows. ``lagged`` and ``running`` work within partitions, too, and carry only one
row a partition over the borders.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.plans.storage import settled

N, P = "__n", "__p"


@dataclass(frozen=True)
class Rows:
    df: DataFrame
    columns: tuple[str, ...]
    order: tuple[tuple[str, bool], ...] = ()  # hidden column, ascending

    @staticmethod
    def of(df: DataFrame, *order: str) -> Rows:
        """Rows of ``df`` in order of some of its columns (none: no order is known)."""
        hidden = {f"__k{k}": F.col(f"`{c}`") for k, c in enumerate(order)}
        return Rows(df.withColumns(hidden) if hidden else df, tuple(df.columns), tuple((k, True) for k in hidden))

    # --- columns ---

    def name(self, ref: str | int) -> str:
        """A visible column by name or, from 0, by position; negative positions count from the end."""
        ref = str(ref).strip()
        if ref in self.columns:
            return ref
        try:
            return self.columns[int(ref)]
        except (ValueError, IndexError):
            raise KeyError(f"no column {ref!r} among {list(self.columns)}") from None

    def has(self, ref: str | int) -> bool:
        try:
            self.name(ref)
        except KeyError:
            return False
        return True

    def col(self, ref: str | int) -> Column:
        return F.col(f"`{self.name(ref)}`")

    def kind(self, ref: str | int) -> T.DataType:
        return self.df.schema[self.name(ref)].dataType

    def number(self, ref: str | int, force: str = "") -> Column:
        """A column as a number: long (also for strings) or double; ``force``: "long" or "double"."""
        floating = isinstance(self.kind(ref), (T.DoubleType, T.FloatType, T.DecimalType))
        return F.expr(f"try_cast(`{self.name(ref)}` AS {force or ('double' if floating else 'bigint')})")

    @property
    def hidden(self) -> list[str]:
        return [k for k, _ in self.order]

    def select(self, columns: dict[str, Column]) -> Rows:
        """New visible columns, the order kept."""
        return replace(self, df=self.df.select(*[c.alias(n) for n, c in columns.items()], *self.hidden), columns=tuple(columns))

    def with_column(self, ref: str, value: Column) -> Rows:
        """Sets a visible column, or appends it."""
        name = self.name(ref) if self.has(ref) else ref
        return replace(self, df=self.df.withColumn(name, value), columns=self.columns if name in self.columns else (*self.columns, name))

    def filter(self, condition: Column) -> Rows:
        """Fewer rows; places that ``numbered`` gave no longer hold."""
        return replace(self, df=self.df.filter(condition).drop(P))

    def unordered(self, df: DataFrame) -> Rows:
        return Rows(df, tuple(df.columns))

    def fresh(self, wanted: str) -> str:
        name, k = wanted, 1
        while name in self.columns:
            name, k = f"{wanted}_{k}", k + 1
        return name

    # --- order ---

    def sort_keys(self) -> list[Column]:
        return [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_first() for k, up in self.order]

    def sorted_by(self, keys: list[tuple[Column, bool]]) -> Rows:
        """Sorted by keys (column, ascending), ties in the order so far. Nulls are last, descending first."""
        old = {f"__s{k + len(keys)}": F.col(h) for k, h in enumerate(self.hidden)}
        new = {f"__s{k}": c for k, (c, _) in enumerate(keys)}
        df = self.df.select(*[F.col(f"`{c}`") for c in self.columns], *[c.alias(n) for n, c in (new | old).items()])
        order = [*zip(new, [up for _, up in keys], strict=True), *zip(old, [up for _, up in self.order], strict=True)]
        names = {n: f"__k{k}" for k, (n, _) in enumerate(order)}
        return Rows(df.withColumnsRenamed(names), self.columns, tuple((names[n], up) for n, up in order))

    def numbered(self) -> Rows:
        """The rows with their place (from 0) and partition, in one order on ``N``."""
        if self.order == ((N, True),) and P in self.df.columns:
            return self
        keys = self.sort_keys()
        visible = [F.col(f"`{c}`") for c in self.columns]
        df = self.df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else self.df
        df = settled(df.select(*visible, F.monotonically_increasing_id().alias(N)), "numbered")
        part = F.shiftright(N, 33).cast("int")
        sizes = df.groupBy(part.alias(P)).agg(F.count("*").alias("__size"))
        before = Window.orderBy(P).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
        offsets = sizes.select(P, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
        df = df.withColumn(P, part).join(F.broadcast(offsets), P)
        within = F.col(N) - F.shiftleft(F.col(P).cast("long"), 33)
        return Rows(df.select(*visible, (within + F.col("__offset")).alias(N), P), self.columns, ((N, True),))

    def shown(self) -> DataFrame:
        """The visible columns, in order if one is known."""
        df = self.df.orderBy(*self.sort_keys()) if self.order else self.df
        return df.select(*[F.col(f"`{c}`") for c in self.columns])

    def plain(self) -> DataFrame:
        """The visible columns, unsorted."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns])


def lagged(rows: Rows, values: dict[str, Column]) -> Rows:
    """``rows`` numbered, with the previous row's values under hidden names, and ``__first`` for the first row."""
    rows = rows.numbered()
    df = rows.df.withColumns({f"{k}": v for k, v in values.items()})
    within = Window.partitionBy(P).orderBy(N)
    last = df.groupBy(P).agg(F.max_by(F.struct(N, *values), N).alias("x"))  # one row a partition
    last = last.select((F.col(f"x.{N}") + 1).alias("__at"), *[F.col(f"x.{k}").alias(f"__b{k}") for k in values])
    df = df.withColumn("__own", F.row_number().over(within) > 1)
    df = df.withColumns({f"__l{k}": F.lag(k).over(within) for k in values})
    df = df.join(F.broadcast(last), F.col(N) == F.col("__at"), "left")
    df = df.withColumns({k: F.when(F.col("__own"), F.col(f"__l{k}")).otherwise(F.col(f"__b{k}")) for k in values})
    df = df.withColumn("__first", F.col(N) == 0)
    return Rows(df.drop("__own", "__at", *[f"__l{k}" for k in values], *[f"__b{k}" for k in values]), rows.columns, rows.order)


def running(rows: Rows, name: str, value: Column, how: str) -> Rows:
    """``rows`` numbered, with the sum (of none: 0), min or max of ``value`` from the first row to this one."""
    rows = rows.numbered()
    aggregate = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    df = rows.df.withColumn("__v", value)
    parts = df.groupBy(P).agg(aggregate("__v").alias("__t"))
    before = Window.orderBy(P).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select(P, aggregate("__t").over(before).alias("__c"))
    own = aggregate("__v").over(Window.partitionBy(P).orderBy(N).rowsBetween(Window.unboundedPreceding, 0))
    both = {"sum": F.coalesce(own, F.lit(0)) + F.coalesce("__c", F.lit(0)), "min": F.least(own, "__c"), "max": F.greatest(own, "__c")}[how]
    df = df.join(F.broadcast(parts), P).withColumn(name, both).drop("__v", "__c")
    return Rows(df, rows.columns, rows.order)


def islands(rows: Rows, keys: list[Column]) -> Rows:
    """``rows`` numbered, with ``__island``: the number of the run of rows with equal adjacent keys."""
    key = F.struct(*[F.coalesce(k.cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k"))
    rows = lagged(Rows(rows.numbered().df.withColumn("__key", key), rows.columns, ((N, True),)), {"__before": key})
    rows = running(rows, "__island", F.when(F.col("__first") | (F.col("__key") != F.col("__before")), 1).otherwise(0), "sum")
    return replace(rows, df=rows.df.drop("__before", "__first", "__key"))
