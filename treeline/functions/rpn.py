"""Reverse Polish programs over columns, compiled to one Spark expression a result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.plans.rows import Rows

_NAMES = {
    "+": "add", "-": "sub", "*": "mult", "prod": "mult", "dprod": "dmult", "/": "div", "%": "rem", "d": "dup", "x": "swap", "drop": "pop",
    "s": "set", "=": "set", "out": "shiftout", "==": "deq", ">>": "dgt", ">>=": "dgteq", "<<": "dlt", "<<=": "dlteq",
}
_TESTS = {"gt": "__gt__", "gteq": "__ge__", "lt": "__lt__", "lteq": "__le__", "eq": "__eq__"}


def _double(c: Column) -> Column:
    return c.cast("double")


def _long(c: Column) -> Column:
    return c.cast("bigint")


class Program:
    """Runs the tokens on a stack of (expression, is double). A term that isn't a number drops its row."""

    def __init__(self, rows: Rows):
        self.rows = rows
        self.stack: list[tuple[Column, bool]] = []
        self.tests: list[Column] = []
        self.vector = self.strict = False

    def push(self, value: Column, floating: bool) -> None:
        self.stack.append((value, floating))

    def load(self, ref: str) -> None:
        rows, kind = self.rows, self.rows.kind(ref).typeName()
        if kind in ("double", "float", "decimal"):
            self.push(rows.number(ref, "double"), True)
        else:
            self.push(rows.number(ref, "bigint"), False)
        self.tests.append(self.stack[-1][0].isNotNull())

    def two(self):
        (a, fa), (b, fb) = self.stack.pop(), self.stack.pop()
        return a, b, fa or fb

    def fold(self, f, floating: bool | None = None) -> None:
        terms = [self.stack.pop(), self.stack.pop()]
        if self.vector:
            terms += self.stack[::-1]
            self.stack.clear()
        value, kind = terms[0]
        for v, k in terms[1:]:
            value, kind = f(v, value), kind or k
        self.push(value, kind if floating is None else floating)
        self.vector = False

    def token(self, raw: str) -> None:
        name = _NAMES.get(raw, raw)
        if name == "vector":
            self.vector = True
        elif name in ("add", "mult", "dmult", "min", "max"):
            f = {"add": lambda b, a: b + a, "mult": lambda b, a: b * a, "dmult": lambda b, a: _double(b) * _double(a), "min": F.least, "max": F.greatest}[name]
            self.fold(f, True if name == "dmult" else None)
        elif name == "sub":
            a, b, f = self.two()
            self.push(b - a, f)
        elif name == "diverr":
            self.strict = True
        elif name in ("tob", "btof"):  # the bits of a double as a long, and back
            a, _ = self.stack.pop()
            how, given = ("doubleToRawLongBits", _double(a)) if name == "tob" else ("longBitsToDouble", _long(a))
            self.push(F.call_function("java_method", F.lit("java.lang.Double"), F.lit(how), given).cast("bigint" if name == "tob" else "double"), name == "btof")
        elif name in ("div", "ddiv", "rem") and self.strict:
            a, b, f = self.two()
            zero = F.raise_error(F.lit("division by zero"))
            if name == "ddiv" or f and name == "div":
                self.push(F.when(_double(a) == 0, zero.cast("double")).otherwise(F.try_divide(_double(b), _double(a))), True)
            else:
                self.push(F.when(_long(a) == 0, zero.cast("bigint")).otherwise(F.try_mod(_long(b), _long(a)) if name == "rem" else F.call_function("div", _long(b), F.nullif(_long(a), F.lit(0).cast("bigint")))), False)
        elif name in ("div", "ddiv", "rem"):
            a, b, f = self.two()
            if name == "ddiv" or f and name == "div":
                self.push(F.when(_double(a) == 0, 0.0).otherwise(_double(b) / F.nullif(_double(a), F.lit(0.0))), True)
            elif name == "rem":
                self.push(F.when(_long(a) == 0, 0).otherwise(F.try_mod(_long(b), _long(a))), False)
            else:
                safe = F.nullif(_long(a), F.lit(0).cast("bigint"))
                self.push(F.when(_long(a) == 0, 0).otherwise(F.call_function("div", _long(b), safe)), False)
        elif name in ("log", "sqrt", "abs"):
            a, _ = self.stack.pop()
            self.push({"log": F.log10, "sqrt": F.sqrt, "abs": F.abs}[name](_double(a)), True)
        elif name == "dup":
            self.stack.append(self.stack[-1])
        elif name == "swap":
            self.stack[-1], self.stack[-2] = self.stack[-2], self.stack[-1]
        elif name == "pop":
            self.stack.pop()
        elif name in _TESTS or name[:1] == "d" and name[1:] in _TESTS:
            a, b, _ = self.two()
            cast = _double if name not in _TESTS else _long
            self.tests.append(F.coalesce(getattr(cast(b), _TESTS[name.removeprefix("d") if name not in _TESTS else name])(cast(a)), F.lit(False)))
        elif name in ("toi", "tof"):
            a, _ = self.stack.pop()
            self.push(_long(a) if name == "toi" else _double(a), name == "tof")
        elif name in ("minif", "maxif"):  # floor and cap: minif gives the larger, maxif the smaller of the two
            a, b, f = self.two()
            self.push((F.greatest if name == "minif" else F.least)(b, a), f)
        elif name in ("mean", "variance"):
            terms = [_double(v) for v, _ in self.stack]
            self.stack.clear()
            mean = sum(terms[1:], terms[0]) / len(terms)
            squares = [(t - mean) * (t - mean) for t in terms]
            self.push(mean if name == "mean" else sum(squares[1:], squares[0]) / len(terms), True)
        elif name == "set":
            (ref, _), (value, _) = self.stack.pop(), self.stack.pop()
            self.write(int(self.last_constant), value)
            del ref
        elif name == "shiftout":
            value, _ = self.stack.pop()
            self.write(None, value)
        elif raw[:1] in "cC" and len(raw) > 1:
            for ref in (raw[1:].split(":") if raw[0] == "c" else [raw[1:]]):
                self.load(ref)
        elif raw[:1] in "nv" and len(raw) > 1:
            for x in raw[1:].split(":"):
                self.constant(x)
        else:
            self.constant(raw)

    def constant(self, text: str) -> None:
        floating = any(c in text for c in ".eE")
        self.last_constant = text
        self.push(F.lit(float(text)) if floating else F.lit(int(text)).cast("bigint"), floating)

    def write(self, at: int | None, value: Column) -> None:
        rows = self.rows
        if at is None or at >= len(rows.columns):
            self.rows = rows.with_column(rows.fresh(f"c{len(rows.columns)}"), value)
        else:
            self.rows = rows.with_column(rows.columns[at], value)


def calculated(rows: Rows, program: str) -> Rows:
    """Runs ``program`` (tokens between commas). Rows that fail a test or hold no number are dropped."""
    run = Program(rows)
    for token in filter(None, (t.strip() for t in program.split(","))):
        run.token(token)
    out = run.rows
    if run.tests:
        # tests see the columns as they were when the test was compiled, so they go before the writes
        keep = run.tests[0]
        for t in run.tests[1:]:
            keep = keep & t
        flagged = replace(rows, df=rows.df.withColumn("__keep", keep).filter("__keep").drop("__keep"))
        again = Program(flagged)
        for token in filter(None, (t.strip() for t in program.split(","))):
            again.token(token)
        out = again.rows
    return out
