"""Bundle filters: they change fields of a row and say whether it passes.

A spec is {"op": name, options...} or a list (a chain). Each compiles to new columns and a verdict; ``apply``
keeps the rows of a true verdict. Changes made before a chain's failing filter stay, as long as the row does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import dates
from treeline.functions.ordered_filters import ORDERED, occurrence, ordered
from treeline.functions.value_filters import Value, filtered
from treeline.plans.rows import N, Rows

FILTERS: dict[str, Callable[..., tuple[Rows, Column]]] = {}
TRUE = F.lit


def bundle_filter(*names: str):
    def add(f):
        for n in names:
            FILTERS[n] = f
        return f

    return add


def compiled(rows: Rows, spec) -> tuple[Rows, Column]:
    if isinstance(spec, list):
        spec = {"op": "chain", "filter": spec}
    name = spec.get("op", "field")
    if name not in FILTERS:
        raise ValueError(f"no bundle filter named {name!r}")
    return FILTERS[name](rows, **{k: v for k, v in spec.items() if k != "op"})


def apply(rows: Rows, spec) -> Rows:
    rows, verdict = compiled(rows, spec)
    return rows.filter(F.coalesce(verdict, F.lit(False)))


def _get(rows: Rows, field) -> Value:
    return Value(rows.col(field), rows.kind(field)) if rows.has(field) else Value(F.lit(None).cast("string"))


def _put(rows: Rows, field: str, value: Column) -> Rows:
    return rows.with_column(field, value)


@bundle_filter("field", "has", "is-not-empty", "test-field")
def _field(rows, toFilter=None, nullFail=True, to=None, test=False, **options):  # noqa: N803
    source = options.get("from")
    spec = toFilter or options.get("filter") or "pass"
    if isinstance(spec, dict) and spec["op"] in ORDERED:
        rows, result = ordered(rows, source, spec)
        rows = replace(rows, df=rows.df.withColumn("__result", result))
        after = Value(F.col("__result"))
    else:
        after = filtered(_get(rows, source), spec)
    name = f"__verdict{len(rows.df.columns)}"
    passed = after.c.isNotNull() if nullFail else F.lit(True)
    rows = replace(rows, df=rows.df.withColumn(name, ~passed if options.get("not") else passed))
    if not test:
        rows = _put(rows, to or source, after.c)
    return rows, F.col(name)


@bundle_filter("chain")
def _chain(rows, filter=None, failStop=True, failReturn=False):  # noqa: A002, N803
    verdict = F.lit(True)
    for f in filter or []:
        rows, own = _guarded(rows, f, verdict if failStop else None)
        verdict = verdict & F.coalesce(own, F.lit(False)) if failStop else verdict
    return rows, F.lit(True) if failReturn else verdict


def _guarded(rows: Rows, spec, condition: Column | None) -> tuple[Rows, Column]:
    """A filter whose changes hold only where the condition does."""
    if condition is None:
        return compiled(rows, spec)
    flag = f"__when{len(rows.df.columns)}"
    old = replace(rows, df=rows.df.withColumn(flag, condition))
    new, verdict = compiled(old, spec)
    held = f"__own{len(new.df.columns)}"
    df = new.df.withColumn(held, verdict)
    backup = {c: f"__old{len(df.columns)}_{k}" for k, c in enumerate(old.columns)}
    before = replace(old, df=old.df.withColumns({b: old.col(c) for c, b in backup.items()}))
    new, verdict = compiled(before, spec)
    df = new.df.withColumn(held, verdict)
    restore = {c: F.when(F.col(flag), F.col(f"`{c}`")).otherwise(F.col(backup[c]).cast(df.schema[c].dataType) if c in backup else F.lit(None)) for c in new.columns}
    return replace(new, df=df.withColumns(restore).drop(*backup.values())), F.col(held)


@bundle_filter("condition", "if")
def _condition(rows, ifDo=None, elseDo=None, returnFilter=False, **options):  # noqa: N803
    rows, test = compiled(rows, options.get("ifCondition") or options.get("if"))
    name = f"__if{len(rows.df.columns)}"
    rows = replace(rows, df=rows.df.withColumn(name, F.coalesce(test, F.lit(False))))
    test, first, second = F.col(name), F.lit(True), F.lit(True)
    if ifDo or options.get("then"):
        rows, first = _guarded(rows, ifDo or options["then"], test)
    if elseDo or options.get("else"):
        rows, second = _guarded(rows, elseDo or options["else"], ~test)
    return rows, F.when(test, first).otherwise(second) if returnFilter else F.lit(True)


@bundle_filter("test")
def _test(rows, test=None, onTrue=None, onFalse=None):  # noqa: N803
    return _condition(rows, ifDo=onTrue, elseDo=onFalse, returnFilter=True, **{"if": test})


@bundle_filter("try")
def _try(rows, catch=None, **options):
    rows, passed = compiled(rows, options["try"] if "try" in options else options["tryDo"])
    name = f"__try{len(rows.df.columns)}"
    rows = replace(rows, df=rows.df.withColumn(name, F.coalesce(passed, F.lit(False))))
    rows, second = _guarded(rows, catch, ~F.col(name))
    return rows, F.col(name) | second


@bundle_filter("map")
def _map(rows, fields=None, exitFail=False):  # noqa: N803
    verdict = F.lit(True)
    for f in fields or []:
        rows, own = _field(rows, **f)
        verdict = verdict & own if exitFail else verdict
    return rows, verdict


@bundle_filter("value")
def _value(rows, to, value, filter=None):  # noqa: A002
    given = Value(F.lit(value), T.StringType() if isinstance(value, str) else T.LongType())
    return _put(rows, to, (filtered(given, filter) if filter else given).c), F.lit(True)


@bundle_filter("append")
def _append(rows, to, values=None, unique=False, **options):
    now = _get(rows, to)
    items = now.c.cast("array<string>") if now.is_array else F.when(now.c.isNotNull(), F.array(now.text)).otherwise(F.array().cast("array<string>"))
    items = F.coalesce(items, F.array().cast("array<string>"))
    more = F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    if "from" in options:
        own = _get(rows, options["from"])
        more = F.concat(more, own.c.cast("array<string>") if own.is_array else F.array_compact(F.array(own.text)))
    return _put(rows, to, F.array_union(items, more) if unique else F.concat(items, more)), F.lit(True)


@bundle_filter("clear")
def _clear(rows, field, removes=False, nullFail=True):  # noqa: N803
    had = _get(rows, field).c.isNotNull() if nullFail else F.lit(True)
    name = f"__had{len(rows.df.columns)}"
    rows = replace(rows, df=rows.df.withColumn(name, had))
    if removes:
        return replace(rows, columns=tuple(c for c in rows.columns if c != field)), F.col(name)
    return _put(rows, field, F.lit(None).cast(rows.kind(field))), F.col(name)


@bundle_filter("concat")
def _concat(rows, out, join="", **options):
    items = [F.array_join(v.c.cast("array<string>"), join) if v.is_array else v.text for v in (_get(rows, f) for f in options["in"])]
    return _put(rows, out, F.concat_ws(join, *items)), F.lit(True)


@bundle_filter("contains")
def _contains(rows, field, value=None, fromField=None, **options):  # noqa: N803
    text = _get(rows, field).text
    found = F.lit(False)
    for v in [value] if isinstance(value, str) else value or []:
        found = found | text.contains(v)
    if fromField:
        found = found | text.contains(_get(rows, fromField).text)
    found = F.coalesce(found, F.lit(False))
    return rows, ~found if options.get("not") else found


@bundle_filter("debug", "log", "sleep")
def _nothing(rows, **options):
    return rows, F.lit(True)


@bundle_filter("error")
def _error(rows, message="error"):
    return rows, F.raise_error(F.lit(message)).cast("boolean")


@bundle_filter("defaults")
def _defaults(rows, default):
    for field, value in default.items():
        now = _get(rows, field)
        rows = _put(rows, field, F.coalesce(now.c, F.lit(value).cast(now.kind)))
    return rows, F.lit(True)


@bundle_filter("equals")
def _equals(rows, left, right, **options):
    same = _get(rows, left).text.eqNullSafe(_get(rows, right).text)
    return rows, ~same if options.get("not") else same


@bundle_filter("first")
def _first(rows, out, which=None, **options):
    fields = options["in"]
    texts = [F.nullif(_get(rows, f).text, F.lit("")) for f in fields]
    if which:
        rows = _put(rows, which, F.coalesce(*[F.when(t.isNotNull(), F.lit(f)) for f, t in zip(fields, texts, strict=True)]))
    rows = _put(rows, out, F.coalesce(*texts))
    return rows, rows.col(out).isNotNull()


@bundle_filter("foreach")
def _foreach(rows, field, filter, to=None):  # noqa: A002
    """A value filter on each element; the row passes if the array isn't empty."""
    own = _get(rows, field)
    done = filtered(own, filter)
    return _put(rows, to or field, done.c), F.coalesce(F.size(own.c) > 0, F.lit(False))


@bundle_filter("json")
def _json(rows, query, json=None, set=None, **options):  # noqa: A002
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in re.split(r"[.\[\]]+", query) if p)
    found = F.get_json_object(_get(rows, json or options["field"]).text, path)
    rows = _put(rows, set or options["to"], found)
    return rows, rows.col(set or options["to"]).isNotNull()


@bundle_filter("limit")
def _limit(rows, limit):
    rows = rows.numbered()
    return rows, F.col(N) < limit


@bundle_filter("map-extract")
def _map_extract(rows, field, map):  # noqa: A002
    own = _get(rows, field)
    for x in map:
        rows = _put(rows, x["to"], F.try_element_at(own.c, F.lit(x["from"])))
    return rows, own.c.isNotNull()


@bundle_filter("not")
def _not(rows, field):
    return rows, _get(rows, field).c.isNull()


@bundle_filter("num")
def _num(rows, define, columns=None):
    """A Reverse Polish program over ``columns``; a row that fails a test doesn't pass."""
    from treeline.functions.rpn import calculated

    own = replace(rows, columns=tuple(columns)) if columns else rows
    done = calculated(own, define)
    return replace(done, columns=tuple(dict.fromkeys([*rows.columns, *done.columns]))), F.lit(True)


@bundle_filter("random-field")
def _random_field(rows, out, inFields):  # noqa: N803
    return _put(rows, out, F.get(F.shuffle(F.array_compact(F.array(*[_get(rows, f).text for f in inFields]))), F.lit(0))), F.lit(True)


@bundle_filter("recent2")
def _recent2(rows, key, time, out, window):
    """How many rows of the key there are within ``window`` milliseconds up to this one."""
    at = Window.partitionBy(rows.name(key)).orderBy(rows.number(time)).rangeBetween(-window, 0)
    return _put(rows, out, F.count("*").over(at)), F.lit(True)


@bundle_filter("recent1")
def _recent1(rows, key, time, out, sample=2):
    """The average time between the last ``sample`` rows of the key."""
    at = Window.partitionBy(rows.name(key)).orderBy(rows.number(time)).rowsBetween(-(sample - 1), 0)
    t = rows.number(time)
    return _put(rows, out, (F.max(t).over(at) - F.min(t).over(at)) / F.nullif(F.count("*").over(at) - 1, F.lit(0))), F.lit(True)


@bundle_filter("template")
def _template(rows, template, set=None, **options):  # noqa: A002
    pieces = re.split(r"\{\{(.*?)\}\}", template)
    parts = [F.lit(p) if k % 2 == 0 else F.coalesce(_get(rows, p).text, F.lit("")) for k, p in enumerate(pieces)]
    return _put(rows, set or options["to"], F.concat(*parts)), F.lit(True)


@bundle_filter("time", "time-to-date")
def _time(rows, src, dst):
    at = dates.read(_get(rows, src["field"]).text, src.get("format", "native"), src.get("timeZone", "UTC"))
    rows = _put(rows, dst["field"], dates.written(at, dst.get("format", "yyMMdd"), dst.get("timeZone", "UTC")))
    return rows, rows.col(dst["field"]).isNotNull()


@bundle_filter("time-range")
def _time_range(rows, field, before=None, after=None, format="native", timeFormat="yyMMdd", defaultExit=True):  # noqa: A002, N803
    at = dates.read(_get(rows, field).text, format)
    bound = lambda t: dates.read(F.lit(str(t)), timeFormat) if not str(t).startswith("-") else F.unix_millis(F.current_timestamp()) - int(str(t)[1:]) * 86_400_000
    inside = F.lit(True)
    if before is not None:
        inside = inside & (at < bound(before))
    if after is not None:
        inside = inside & (at >= bound(after))
    inside = F.coalesce(inside, F.lit(False))
    return rows, inside if defaultExit else ~inside


@bundle_filter("url")
def _url(rows, field, setHost=None, setPath=None, setParams=None, setAnchor=None):  # noqa: N803
    url = _get(rows, field).text
    url = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    for name, value in ((setHost, host), (setPath, F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)), (setParams, F.regexp_extract(url, r"\?([^#]*)", 1)), (setAnchor, F.regexp_extract(url, r"#(.*)$", 1))):
        if name:
            rows = _put(rows, name, value)
    return rows, F.coalesce(F.length(host) > 0, F.lit(False))


@bundle_filter("http")
def _http(rows, field, url, to=None):
    """A request for each distinct row batch value: ``url`` with {{}} for the field's value; the answer's text."""
    from treeline.functions.value_filters import fetched

    return _put(rows, to or field, fetched(_get(rows, field).text, url)), F.lit(True)


# --- of other filters ---


def _held(rows: Rows, verdict: Column) -> tuple[Rows, Column]:
    """The verdict as a hidden column, so that later changes of fields don't change it."""
    name = f"__held{len(rows.df.columns)}"
    return replace(rows, df=rows.df.withColumn(name, F.coalesce(verdict, F.lit(False)))), F.col(name)


@bundle_filter("unary")
def _unary(rows, filter=None, operation="identity"):  # noqa: A002
    """A filter's verdict as it is (``identity``) or not (``negate``), or always ``true`` or ``false``; what it changes stays."""
    rows, own = _held(*compiled(rows, filter)) if filter is not None else (rows, F.lit(True))
    operation = operation.lower()
    if operation in ("true", "false"):
        return rows, F.lit(operation == "true")
    if operation not in ("identity", "negate"):
        raise ValueError(f"no operation {operation!r}")
    return rows, ~own if operation == "negate" else own


def _unary_named(operation: str, *names: str) -> None:
    bundle_filter(*names)(lambda rows, filter=None, **options: _unary(rows, filter if filter is not None else {"op": "field", "test": True, **options} if options else None, operation))


_unary_named("identity", "is", "wrap")
_unary_named("negate", "invert", "isn't", "is not", "is-null-or-empty")
_unary_named("true", "true", "safely", "ignore")
_unary_named("false", "false", "then fail")


@bundle_filter("set")
def _set(rows, to, value, filter=None):  # noqa: A002
    """Sets a field to a constant where the inner filter passes; its verdict is the result."""
    rows, own = _held(*(compiled(rows, filter) if filter is not None else (rows, F.lit(True))))
    now = _get(rows, to)
    return _put(rows, to, F.when(own, F.lit(value)).otherwise(now.text if isinstance(value, str) else now.c)), own


@bundle_filter("limit-cms")
def _limit_by_key(rows, keyFields, limit, valueField=None, bound="UPPER"):  # noqa: N803
    """How often a value was seen under its key, in order of the rows: UPPER keeps the first ``limit``, LOWER what comes
    after them. Counted exactly, not by a sketch."""
    fields = [*([keyFields] if isinstance(keyFields, str) else keyFields), *([valueField] if valueField else [])]
    rows, seen = occurrence(rows, F.to_json(F.array(*[F.coalesce(_get(rows, f).text, F.lit("")) for f in fields])))
    return _held(rows, seen < limit if bound.upper() == "UPPER" else seen >= limit)
