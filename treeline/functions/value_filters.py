"""Value filters: a value in, a value out; null means that it was refused.

Filters are given as a name, or as {"op": name, options...}, or as a list (a chain). Over an array a filter
works on each element; elements that become null go, and an array without elements becomes null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import dates, hashing
from treeline.functions.sketches import in_bloom

FILTERS: dict[str, Callable] = {}
WHOLE: set[str] = set()  # filters that see an array as a whole


@dataclass(frozen=True)
class Value:
    """An expression and its type."""

    c: Column
    kind: T.DataType = T.StringType()

    @property
    def text(self) -> Column:
        return self.c.cast("string")

    @property
    def is_array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)

    @property
    def is_map(self) -> bool:
        return isinstance(self.kind, T.MapType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.kind, T.NumericType)


S, L, D, A = T.StringType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType())


def value_filter(*names: str, whole: bool = False):
    def add(f):
        for n in names:
            FILTERS[n] = f
            if whole:
                WHOLE.add(n)
        return f

    return add


def filtered(value: Value, spec) -> Value:
    """``value`` through the filter that ``spec`` describes."""
    if isinstance(spec, list):
        spec = {"op": "chain", "filter": spec}
    if isinstance(spec, str):
        spec = {"op": spec}
    options = {k: v for k, v in spec.items() if k not in ("op", "once")}
    name = spec["op"]
    if name not in FILTERS:
        raise ValueError(f"no value filter named {name!r}")
    f = FILTERS[name]
    if value.is_array and name not in WHOLE and not spec.get("once"):
        inner = f(Value(F.lit(None).cast(value.kind.elementType), value.kind.elementType), **options).kind
        done = F.filter(F.transform(value.c, lambda x: f(Value(x, value.kind.elementType), **options).c), lambda x: x.isNotNull())
        return Value(F.when(F.size(done) > 0, done), T.ArrayType(inner))
    return f(value, **options)


def _kept(v: Value, test: Column) -> Value:
    return Value(F.when(test, v.c), v.kind)


# --- text ---


@value_filter("case")
def _case(v, upper=False, lower=False):
    return Value(F.upper(v.text) if upper else F.lower(v.text), S)


@value_filter("cat")
def _cat(v, pre="", post=""):
    return Value(F.concat(F.lit(pre), v.text, F.lit(post)), S)


@value_filter("trim")
def _trim(v):
    return Value(F.trim(v.text), S)


@value_filter("set")
def _set(v, value=None):
    return Value(F.lit(value), v.kind if value is None else S if isinstance(value, str) else L if isinstance(value, int) else D)


@value_filter("pass")
def _pass(v):
    return v


@value_filter("default")
def _default(v, value=None, time=False):
    given = F.unix_millis(F.current_timestamp()).cast("string") if time else F.lit(value)
    return Value(F.coalesce(F.nullif(v.text, F.lit("")), given.cast("string")), S)


@value_filter("empty", whole=True)
def _empty(v, **options):
    bare = F.size(v.c) == 0 if v.is_array or v.is_map else F.length(v.text) == 0
    bare = v.c.isNull() | bare
    return Value(F.when(~bare if options.get("not") else bare, F.coalesce(v.c, F.lit("")) if isinstance(v.kind, T.StringType) else v.c), v.kind)


@value_filter("error")
def _error(v, message="error"):
    return Value(F.raise_error(F.lit(message)).cast(v.kind), v.kind)


@value_filter("pad")
def _pad(v, left=None, right=None):
    template = left if left is not None else right
    size = len(template)
    short = F.length(v.text) < size
    if left is not None:
        return Value(F.when(short, F.concat(F.substr(F.lit(template), F.lit(1), size - F.length(v.text)), v.text)).otherwise(v.text), S)
    return Value(F.when(short, F.concat(v.text, F.substr(F.lit(template), F.length(v.text) + 1, F.lit(size)))).otherwise(v.text), S)


def _cut(text: Column, begin: int, end: int | None) -> Column:
    size = F.length(text)
    place = lambda k: F.lit(k) if k >= 0 else F.greatest(size + k, F.lit(0))
    last = size if end is None else F.least(place(end), size)
    return F.substr(text, place(begin) + 1, F.greatest(last - place(begin), F.lit(0)))


@value_filter("range")
def _range(v, start=0, end=None):
    return Value(_cut(v.text, start, end), S)


@value_filter("replace")
def _replace(v, find="", replace="", regex=False):
    return Value(F.regexp_replace(v.text, F.lit(find), F.lit(replace)) if regex else F.replace(v.text, F.lit(find), F.lit(replace)), S)


@value_filter("regex")
def _regex(v, pattern="", replace=None):
    if replace is not None:
        return Value(F.regexp_replace(v.text, F.lit(pattern), F.lit(replace)), S)
    groups = re.compile(pattern).groups
    if not groups:
        return Value(F.array().cast("array<string>"), A)
    found = [F.regexp_extract_all(v.text, F.lit(pattern), g) for g in range(1, groups + 1)]
    every = found[0] if groups == 1 else F.flatten(F.transform(F.arrays_zip(*[f.alias(f"g{k}") for k, f in enumerate(found)]), lambda x: F.array(*[x[f"g{k}"] for k in range(groups)])))
    return Value(F.when(v.c.isNotNull(), every), A)


@value_filter("reverse", whole=True)
def _reverse(v):
    return Value(F.reverse(v.c if v.is_array else v.text), v.kind if v.is_array else S)


@value_filter("length", whole=True)
def _length(v):
    if v.is_array or v.is_map:
        return Value(F.size(v.c).cast("long"), L)
    return v if v.is_number else Value(F.length(v.text).cast("long"), L)


@value_filter("string-slice")
def _string_slice(v, sep=",", fromIndex=0, toIndex=None, join=None):  # noqa: N803
    parts = F.split(v.text, "\\Q" + sep + "\\E")
    return Value(F.array_join(_part(parts, fromIndex, toIndex), sep if join is None else join), S)


def _part(items: Column, begin: int, end: int | None) -> Column:
    size = F.size(items)
    place = lambda k: F.lit(k) if k >= 0 else F.greatest(size + k, F.lit(0))
    last = size if end is None else F.least(place(end), size)
    return F.slice(items, place(begin) + 1, F.greatest(last - place(begin), F.lit(0)))


@value_filter("slice", whole=True)
def _slice(v, **options):
    begin, end = options.get("from", 0), options.get("to")
    return Value(_part(v.c, begin, end), v.kind) if v.is_array else Value(_cut(v.text, begin, end), S)


@value_filter("contains", whole=True)
def _contains(v, value=None, key=None, returnMatch=False, **options):  # noqa: N803
    wanted = [value] if isinstance(value, str) else list(value or key or [])
    if v.is_array:
        test = F.arrays_overlap(v.c.cast("array<string>"), F.array(*map(F.lit, wanted)))
    elif v.is_map:
        test = F.arrays_overlap(F.map_keys(v.c), F.array(*map(F.lit, key or wanted)))
    else:
        test = F.lit(False)
        for w in wanted:
            test = test | v.text.contains(w)
        if returnMatch:
            match = F.coalesce(*[F.when(v.text.contains(w), F.lit(w)) for w in wanted])
            return Value(match, S)
    return _kept(v, ~test if options.get("not") else test)


def _matched(v: Value, value=None, match=None, find=None, contains=None) -> Column:
    as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
    test = F.lit(False)
    if value:
        test = test | v.text.isin(as_list(value))
    for p in as_list(match):
        test = test | v.text.rlike(f"^(?:{p})$")
    for p in as_list(find):
        test = test | v.text.rlike(p)
    for t in as_list(contains):
        test = test | v.text.contains(t)
    return test


@value_filter("require")
def _require(v, **options):
    return _kept(v, (F.length(v.text) == 0) | _matched(v, **options))


@value_filter("exclude")
def _exclude(v, **options):
    return _kept(v, ~_matched(v, **options))


@value_filter("glob")
def _glob(v, pattern="*"):
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if pattern[at : at + 2] == "**":
            out, at = out + ".*", at + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c in "{},":
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        elif c == "[":
            end = pattern.index("]", at)
            out, at = out + pattern[at : end + 1].replace("[!", "[^"), end
        else:
            out += re.escape(c)
        at += 1
    return _kept(v, v.text.rlike(f"^(?:{out})$"))


# --- numbers ---


@value_filter("mod")
def _mod(v, mod=1, abs=True):  # noqa: A002
    n = v.text.try_cast("bigint")
    return Value((F.abs(n) if abs else n) % mod, L)


@value_filter("inequality")
def _inequality(v, double=False, **tests):
    n = v.text.try_cast("double" if double else "bigint")
    keep = F.lit(True)
    for name, limit in tests.items():
        keep = keep & {"gteq": n >= limit, "lteq": n <= limit, "lt": n < limit, "gt": n > limit, "eq": n == limit}[name]
    return _kept(v, n.isNull() | keep)


@value_filter("intbase")
def _int_base(v, **options):
    return Value(F.lower(F.conv(v.text, options.get("in", 10), options.get("out", 10))), S)


@value_filter("baseconv")
def _base_conv(v, base=36):
    if base != 36:
        raise ValueError("baseconv reads base 36")
    return Value(F.conv(v.text, 36, 10).try_cast("bigint"), L)


@value_filter("bit-split")
def _bit_split(v, mask=None):
    n = v.text.try_cast("bigint")
    n = n.bitwiseAND(mask) if mask is not None else n
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", n, k).bitwiseAND(1) == 1)
    return Value(F.when(n > 0, bits.cast("array<bigint>")), T.ArrayType(L))


@value_filter("random")
def _random(v, max=1 << 31, float=False, gaussian=False):  # noqa: A002
    if gaussian:
        return Value(F.randn(), D)
    return Value(F.rand(), D) if float else Value(F.floor(F.rand() * max).cast("long"), L)


# --- hashes and codes ---


@value_filter("md5")
def _md5(v):
    return Value(F.md5(v.text.cast("binary")), S)


@value_filter("base64")
def _base64(v, decode=False):
    return Value(F.try_to_binary(v.text, F.lit("base64")).cast("string") if decode else F.base64(v.text.cast("binary")), S)


@value_filter("hexdump")
def _hex_dump(v, reverse=False):
    if reverse:
        return Value(F.unhex(F.replace(v.text, F.lit(" "), F.lit(""))).cast("string"), S)
    return Value(F.trim(F.regexp_replace(F.lower(F.hex(v.text.cast("binary"))), "(..)", "$1 ")), S)


@value_filter("hash")
def _hash(v, type=1, abs=False):  # noqa: A002
    if type == 4:
        return Value(F.sha1(v.text.cast("binary")), S)
    if type == 3:
        n = F.conv(F.substr(F.sha1(v.text.cast("binary")), F.lit(1), F.lit(16)), 16, -10).cast("bigint")
    elif type in (1, 5):
        n = hashing.murmur3(v.c)
    elif type == 0:
        n = hashing.java_hash_code(v.c)
    else:
        raise ValueError(f"hash has no type {type}")
    return Value(F.abs(n) if abs else n, L)


# --- arrays and maps ---


@value_filter("split")
def _split(v, split=",", keySplit=None, fixedLength=0, filter=None, keyFilter=None):  # noqa: A002, N803
    """An array, or with ``keySplit`` a map: of equal keys the last counts, a part without the sign is key and value."""
    parts = F.regexp_extract_all(v.text, F.lit(f"(?s).{{1,{fixedLength}}}"), 0) if fixedLength > 0 else F.split(v.text, "\\Q" + split + "\\E")
    parts = F.when(v.text != "", parts)

    def changed(text: Column, how) -> Column:
        return text if how is None else filtered(Value(text, S), how).text

    if keySplit is None:
        return Value(parts if filter is None else F.transform(parts, lambda p: changed(p, filter)), A)

    def entry(p: Column) -> Column:
        at = F.instr(p, keySplit)
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + len(keySplit), F.length(p))).otherwise(p)
        return F.struct(changed(key, keyFilter).alias("key"), changed(value, filter).alias("value"))

    entries = F.filter(F.transform(parts, entry), lambda e: e["key"].isNotNull())
    backwards = F.reverse(entries["key"])
    last = F.filter(entries, lambda e, i: F.array_position(backwards, e["key"]) == F.size(backwards) - i)
    return Value(F.map_from_entries(last), T.MapType(S, S))


@value_filter("create-map")
def _create_map(v, split=",", keySplit="="):  # noqa: N803
    return _split(v, split, keySplit)


@value_filter("join", whole=True)
def _join(v, join=",", keyJoin="=", sort=False):  # noqa: N803
    if v.is_map:
        items = F.transform(F.map_entries(v.c), lambda e: F.concat(e["key"].cast("string"), F.lit(keyJoin), e["value"].cast("string")))
    elif v.is_array:
        items = v.c.cast("array<string>")
    else:
        return v
    return Value(F.array_join(F.array_sort(items) if sort else items, join), S)


@value_filter("sort", whole=True)
def _sort(v, reverse=False):
    return Value(F.sort_array(v.c, asc=not reverse), v.kind) if v.is_array else v


@value_filter("index", whole=True)
def _index(v, index=0, toNull=False):  # noqa: N803
    if not v.is_array:
        return v
    found = F.get(v.c, F.lit(index) if index >= 0 else F.size(v.c) + index)
    return Value(found, v.kind.elementType)


@value_filter("list-apply", whole=True)
def _list_apply(v, filter=None):  # noqa: A002
    return filtered(v, filter) if v.is_array else Value(F.lit(None).cast("string"), S)


@value_filter("map")
def _map(v, map=None, default=None, toNull=False):  # noqa: A002, N803
    table = F.create_map(*[F.lit(str(x)) for kv in (map or {}).items() for x in kv])
    found = F.try_element_at(table, v.text)
    return Value(found if toNull else F.coalesce(found, F.lit(default) if default is not None else v.text), S)


@value_filter("map-value", whole=True)
def _map_value(v, key=None, default=None, put=None):
    if put is not None:
        return Value(F.map_concat(F.map_filter(v.c, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(put))), v.kind)
    return Value(F.coalesce(F.try_element_at(v.c, F.lit(key)), F.lit(default)), v.kind.valueType)


@value_filter("map-subset", whole=True)
def _map_subset(v, whitelist=None, blacklist=None, toString=False):  # noqa: N803
    kept = F.map_filter(v.c, lambda k, _: k.isin(whitelist) if whitelist is not None else ~k.isin(blacklist or []))
    return Value(F.to_json(kept), S) if toString else Value(kept, v.kind)


@value_filter("json")
def _json(v, schema=None):
    return Value(F.from_json(v.text, schema), T._parse_datatype_string(schema)) if schema else Value(F.try_parse_json(v.text), T.VariantType())


@value_filter("pretty-print", whole=True)
def _pretty(v):
    return Value(F.to_json(v.c) if v.is_array or v.is_map else v.text, S)


# --- time ---


@value_filter("time-format")
def _time_format(v, formatIn="native", formatOut="native", timeZoneIn="UTC", timeZoneOut="UTC"):  # noqa: N803
    at = dates.read(v.text, formatIn, timeZoneIn)
    return Value(dates.written(F.when(at >= 0, at), formatOut, timeZoneOut), S)


@value_filter("time-range")
def _time_range(v, format="yyMMdd", days=0, hours=0, range=False):  # noqa: A002
    unit = 3_600_000 if hours else 86_400_000
    step = hours or days
    at = dates.read(v.text, format)
    if not range:
        return Value(dates.written(at + step * unit, format), S)
    places = F.sequence(F.lit(0), F.lit(step))
    return Value(F.transform(places, lambda k: dates.written(at + k.cast("bigint") * unit, format)), A)


@value_filter("date-range-length")
def _date_range_length(v, format="yyMMdd", dateSep=",", rangeSep="-"):  # noqa: A002, N803
    day = lambda t: F.to_date(F.timestamp_millis(dates.read(t, format)))
    parts = F.split(v.text, "\\Q" + dateSep + "\\E")
    days = F.transform(parts, lambda p: F.sequence(day(F.split_part(p, F.lit(rangeSep), F.lit(1))), F.coalesce(day(F.nullif(F.split_part(p, F.lit(rangeSep), F.lit(2)), F.lit(""))), day(F.split_part(p, F.lit(rangeSep), F.lit(1))))))
    return Value(F.size(F.array_distinct(F.flatten(days))).cast("long"), L)


# --- of other filters ---


@value_filter("chain", whole=True)
def _chain(v, filter=None, nullStop=True):  # noqa: A002, N803
    for f in filter or []:
        after = filtered(v, f)
        v = Value(F.when(v.c.isNotNull(), after.c), after.kind) if nullStop else after
    return v


@value_filter("not", whole=True)
def _not(v, filter=None):  # noqa: A002
    return _kept(v, filtered(v, filter).c.isNull())


@value_filter("seen")
def _seen(v, bloom=None, hashes=4, **options):
    """Values that a Bloom filter (its bytes, as the op ``seen`` makes them) may hold; with ``not``, the others."""
    known = in_bloom(F.lit(bytes(bloom)), v.c, hashes, whole=True)
    return _kept(v, ~known if options.get("not") else known)


@value_filter("python", "eval-java", "javascript")
def _python(v, body=None, type="string"):  # noqa: A002
    """A user's function of one value, given as Python (a callable or the text of a lambda), run on Arrow batches."""
    f = body if callable(body) else eval(body, {"json": json, "re": re})  # noqa: S307

    @F.pandas_udf(type)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return Value(apply(v.c), T._parse_datatype_string(type))


@value_filter("cache", whole=True)
def _cache(v, value=None, filter=None):  # noqa: A002
    """The filter's result for one given value, for all rows."""
    return filtered(Value(F.lit(value), v.kind if value is None else S), filter) if filter else Value(F.lit(value), S)


@value_filter("grepTags")
def _grep_tags(v, tagName="a", tagAttrs=(), values=()):  # noqa: N803
    """How often each value is in the attributes of a page's tags of one name (none: null)."""
    tag = re.compile(rf"<{re.escape(tagName)}\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.I)
    attribute = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
    wanted, texts = {a.lower() for a in tagAttrs}, list(values)

    def count(html: str) -> dict | None:
        found: dict[str, int] = {}
        for m in tag.finditer(html):
            given = {a[0].lower(): "".join(a[1:]).lower() for a in attribute.findall(m[1])}
            for a in wanted & given.keys():
                for t in texts:
                    if t in given[a]:
                        found[t] = found.get(t, 0) + 1
        return found or None

    @F.pandas_udf("map<string,int>")
    def apply(pages: pd.Series) -> pd.Series:
        return pages.map(count, na_action="ignore")

    return Value(apply(v.text), T.MapType(S, T.IntegerType()))


def _fetch(url: str) -> str:
    import urllib.request

    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return answer.read().decode(errors="replace")


def fetched(value: Column, url: str) -> Column:
    """The answer to ``url`` with {{}} replaced by the value; equal values of a batch are asked for once."""

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        known = {x: _fetch(url.replace("{{}}", str(x))) for x in values.dropna().unique()}
        return values.map(known)

    return apply(value)


@value_filter("httpget")
def _http_get(v, template="{{}}"):
    return Value(fetched(v.text, template), S)


@value_filter("fetch-once")
def _fetch_once(v, url=None):
    """One request, made by the driver."""
    return Value(F.lit(_fetch(url)), S)
