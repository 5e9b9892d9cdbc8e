"""Counted trees as node tables, and path queries over them.

A tree is described by path elements: {"const": name}, {"field": column}, {"file": column, "sep": "/"},
{"keyop": {...bundle filter}} (changes fields, makes no node), {"call": name} (the elements of that name in ``named``), {"op": ...} and
{"debug": ...} (nothing), {"branch": [[...], [...]]}, or a list of elements. Elements of a value take ``filter`` (or ``vfilter``),
``set`` (the field that gets the value, for later elements), ``op`` (True: no node, only ``set``), ``term`` (True: nothing below)
and ``count`` (False: touches don't count as hits). Each row touches the nodes of
each prefix of its paths once; ``hits`` counts touches. One explode and one aggregation with map-side combining
build the node table: path, depth, name, hits, nodes (children), and the buffers of attachments.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.dates import expanded
from treeline.functions.sketches import bloom_filters, empty_bloom
from treeline.functions.value_filters import Value, filtered
from treeline.plans.attachments import NODE, OF_CHILDREN, Attachment, made
from treeline.plans.rows import Rows


@dataclass(frozen=True)
class Tree:
    nodes: DataFrame
    attachments: dict[str, Attachment] = field(default_factory=dict)
    of_children: frozenset[str] = frozenset()
    bare: DataFrame | None = None  # the nodes without the buffers that ``beside`` adds, by attachment
    beside: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def reading(self, names: set[str]) -> Tree:
        """The tree with the buffers of these attachments; those of others that were made apart are not computed."""
        if self.bare is None:
            return self
        nodes = self.bare
        for n, add in self.beside.items():
            nodes = add(nodes) if n in names else nodes
        return Tree(nodes, self.attachments, self.of_children)


def _value(df: DataFrame, element: dict) -> Value:
    """The value of an element for a row, filtered."""
    if "const" in element:
        value = Value(F.lit(str(element["const"])), T.StringType())
    else:
        column = element.get("field") or element.get("file") or element.get("value")
        value = Value(F.col(f"`{column}`"), df.schema[column].dataType)
    how = element.get("filter") or element.get("vfilter")
    return filtered(value, how) if how else value


def _names(value: Value) -> Column:
    """The names of a value's nodes: an array of texts, empty where the path stops."""
    none = F.array().cast("array<string>")
    if value.is_map:
        return F.coalesce(F.map_keys(value.c).cast("array<string>"), none)
    items = value.c.cast("array<string>") if value.is_array else F.array(value.text)
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (x != "")), none)


class _Builder:
    def __init__(self, df: DataFrame, named: dict[str, list] | None = None):
        self.df = df
        self.named, self.open, self.changes = named or {}, [], False
        self.touches: list[tuple[Column, int]] = []  # arrays of paths, and the element's number
        self.specs: dict[int, dict] = {}
        self.uncounted: list[int] = []

    def add(self, elements: list, prefixes: Column) -> Column:
        for e in elements:
            if isinstance(e, list):
                prefixes = self.add(e, prefixes)
            elif isinstance(e, str):
                prefixes = self.level({"field": e}, prefixes)
            elif "branch" in e:
                for sub in e["branch"]:
                    self.add(sub if isinstance(sub, list) else [sub], prefixes)
            elif "file" in e:
                prefixes = self.file(e, prefixes)
            elif "keyop" in e:
                self.df = self.changed(e["keyop"])
            elif "call" in e or "path" in e:
                name = e.get("call") or e["path"]
                if name in self.open:
                    raise ValueError(f"path {name!r} calls itself")
                self.open.append(name)
                prefixes = self.add(self.named[name], prefixes)
                self.open.pop()
            elif e.get("op") is True and "set" in e:
                self.df = self.df.withColumn(e["set"], _value(self.df, e).c)
            elif e.get("op") or "debug" in e:
                continue
            else:
                prefixes = self.level(e, prefixes)
                if e.get("term"):
                    return F.slice(prefixes, 1, 0)
        return prefixes

    def changed(self, spec) -> DataFrame:
        """The rows with the fields that a bundle filter changes; its verdict keeps no row away."""
        from treeline.functions.bundle_filters import compiled

        return compiled(Rows.of(self.df), spec)[0].plain()

    def level(self, e: dict, prefixes: Column) -> Column:
        value = _value(self.df, e)
        values = _names(value)
        if self.changes:  # later changes of fields are not for this level
            hold = f"__level{len(self.specs)}"
            self.df = self.df.withColumn(hold, values)
            values = F.col(hold)
        if "set" in e:
            self.df = self.df.withColumn(e["set"], value.c)
        nested = F.flatten(F.transform(prefixes, lambda p: F.transform(values, lambda v: F.array_append(p, v))))
        number = len(self.specs)
        self.specs[number] = e.get("data", {})
        self.touches.append((nested, number))
        if not e.get("count", True):
            self.uncounted.append(number)
        return nested

    def file(self, e: dict, prefixes: Column) -> Column:
        sep, depth = e.get("sep", "/"), e.get("depth", 0)
        parts = F.filter(F.split(F.coalesce(F.col(f"`{e['file']}`").cast("string"), F.lit("")), "\\Q" + sep + "\\E"), lambda x: x != "")
        parts = F.slice(parts, 1, depth) if depth else parts
        heads = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.slice(parts, 1, n))).otherwise(F.array().cast("array<array<string>>"))
        number = len(self.specs)
        self.specs[number] = e.get("data", {})
        self.touches.append((F.flatten(F.transform(prefixes, lambda p: F.transform(heads, lambda h: F.concat(p, h)))), number))
        whole = F.when(F.size(parts) > 0, F.array(parts)).otherwise(F.array().cast("array<array<string>>"))
        return F.flatten(F.transform(prefixes, lambda p: F.transform(whole, lambda h: F.concat(p, h))))


def built(df: DataFrame, elements: list, where: Column | None = None, hits: str | None = None, named: dict[str, list] | None = None) -> Tree:
    """The tree of all rows (of those that ``where`` keeps). ``hits``: a column that counts instead of 1; ``named``: elements
    that others call."""
    df = df.filter(where) if where is not None else df
    b = _Builder(df, named)
    b.changes = any(f"'{word}'" in repr((elements, named)) for word in ("keyop", "set"))
    b.add(elements, F.array(F.array().cast("array<string>")))
    df = b.df
    attachments = {n: made(s) for specs in b.specs.values() for n, s in specs.items()}
    of_children = frozenset(n for specs in b.specs.values() for n, s in specs.items() if s["type"] in OF_CHILDREN)
    keys = {f: f"__a_{f}" for a in attachments.values() for f in a.keys.values()}
    def tagged(paths: Column, n: int) -> Column:
        return F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(n).alias("element")))

    touch = F.flatten(F.array(*[tagged(paths, n) for paths, n in b.touches]))
    count = F.col(f"`{hits}`").cast("long") if hits else F.lit(1).cast("long")
    rows = df.select(F.explode(touch).alias("t"), count.alias("__hits"), *[F.col(f"`{f}`").alias(a) for f, a in keys.items()]).select("t.path", "t.element", "__hits", *keys.values())
    counted = F.when(F.col("element").isin(b.uncounted), F.lit(0)).otherwise(F.col("__hits")) if b.uncounted else F.col("__hits")
    aggregates = [F.sum(counted).alias("hits")]
    for n, specs in b.specs.items():
        for name in specs:
            own = lambda c, n=n: F.when(F.col("element") == n, c)
            a = attachments[name]
            aggregates += [c.alias(f"{name}.{suffix}") for suffix, c in a.aggregates(own, lambda k, a=a: F.col(keys[a.keys[k]])).items()]
    bare = with_children(rows.groupBy("path").agg(*aggregates))
    beside = {}
    for n, specs in b.specs.items():
        for name in specs:
            a = attachments[name]
            if a.top or a.recent or a.distinct or a.bloom:
                key = F.col(f"`{a.keys['key']}`").cast("string")
                values = df.select(F.explode(dict((m, paths) for paths, m in b.touches)[n]).alias("path"), key.alias("name"))
            if a.top:
                beside[name] = _adding(_most_frequent(values, a.top, f"{name}.top"))
            if a.recent:
                beside[name] = _adding(_latest(values.select("path", F.col("name").try_cast("bigint").alias("epoch")), a.recent, f"{name}.recent"))
            if a.distinct:
                beside[name] = _adding(_distinct(values).groupBy("path").agg(F.count("*").alias(f"{name}.{a.distinct}")), F.lit(0))
            if a.bloom:
                beside[name] = _adding(bloom_filters(_distinct(values), f"{name}.bits", *a.bloom), empty_bloom(*a.bloom))
    full = bare
    for add in beside.values():
        full = add(full)
    return Tree(full, attachments, of_children, bare, beside)


def _adding(table: DataFrame, none: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds to nodes the buffer of a table (path, buffer), or ``none`` where the table has no such path."""
    to = table.columns[1]

    def add(nodes: DataFrame) -> DataFrame:
        nodes = nodes.join(table, "path", "left")
        return nodes if none is None else nodes.withColumn(to, F.coalesce(F.col(f"`{to}`"), none))

    return add


def _distinct(values: DataFrame) -> DataFrame:
    """The different names of each path. They are shuffled by path and name, so no task sees all of a path."""
    return values.filter("name IS NOT NULL").select("path", "name").distinct()


def _latest(values: DataFrame, size: int, to: str) -> DataFrame:
    """path, and the counts of its last ``size`` epochs, the latest first."""
    counts = values.filter("epoch IS NOT NULL").groupBy("path", "epoch").agg(F.count("*").alias("hits"))
    rank = Window.partitionBy("path").orderBy(F.desc("epoch"))
    best = counts.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= size)
    listed = F.array_sort(F.collect_list(F.struct("r", "epoch", "hits")))
    within = F.filter(listed, lambda x: x["epoch"] > F.get(listed, F.lit(0))["epoch"] - size)
    return best.groupBy("path").agg(F.transform(within, lambda x: F.struct(x["epoch"].cast("string").alias("name"), x["hits"].alias("hits"))).alias(to))


def _most_frequent(values: DataFrame, size: int, to: str) -> DataFrame:
    """path, and the ``size`` most frequent names of each path. Ranks are cut before they are shuffled."""
    counts = values.filter("name IS NOT NULL").groupBy("path", "name").agg(F.count("*").alias("hits"))
    rank = Window.partitionBy("path").orderBy(F.desc("hits"), "name")
    best = counts.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= size)
    listed = F.array_sort(F.collect_list(F.struct("r", "name", "hits")))
    return best.groupBy("path").agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["hits"].alias("hits"))).alias(to))


def with_children(nodes: DataFrame) -> DataFrame:
    """Adds depth, name and the number of children to nodes (path, hits, ...)."""
    nodes = nodes.withColumns({"depth": F.size("path"), "name": F.element_at("path", -1)})
    parents = nodes.filter("depth > 1").select(F.slice("path", F.lit(1), F.col("depth") - 1).alias("path")).groupBy("path").agg(F.count("*").alias("nodes"))
    counted = nodes.join(parents, "path", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    first = ["path", "depth", "name", "hits", "nodes"]
    return counted.select(*first, *[F.col(f"`{c}`") for c in counted.columns if c not in first])


def merged(a: Tree, b: Tree) -> Tree:
    """The tree of the rows of both: hits add up, and so do attachments whose buffers combine."""
    fixed = {"path", "depth", "name", "hits", "nodes"}
    how = {f"{n}.{s}": f for n, x in a.attachments.items() for s, f in x.merges.items()}
    buffers = [c for c in a.nodes.columns if c not in fixed]
    if lost := [c for c in buffers if c not in how]:
        raise ValueError(f"these attachments don't combine: {lost}")
    both = a.nodes.unionByName(b.nodes)
    nodes = both.groupBy("path").agg(F.sum("hits").alias("hits"), *[how[c](F.col(f"`{c}`")).alias(c) for c in buffers])
    return Tree(with_children(nodes), a.attachments, a.of_children)


def pruned(tree: Tree, below: list[str], keep: Column) -> Tree:
    """Without the children of ``below`` (a path; * for any name) that ``keep`` refuses, and all under them.
    ``keep`` sees the child's name as ``name`` and its path as ``path``."""
    depth = len(below) + 1
    under = F.col("depth") >= depth
    for k, n in enumerate(below):
        under = under & (F.lit(True) if n == "*" else F.get("path", F.lit(k)) == n)
    named = tree.nodes.withColumn("__name", F.col("name")).withColumn("name", F.get("path", F.lit(depth - 1)))
    kept = named.filter(~under | F.coalesce(keep, F.lit(False))).withColumn("name", F.col("__name")).drop("__name", "nodes", "depth", "name")
    return Tree(with_children(kept), tree.attachments, tree.of_children)


def limited(tree: Tree, below: list[str], size: int, by: str = "hits", age: int | None = None) -> Tree:
    """Of the children of each node that matches ``below`` (* for any name), the ``size`` of the greatest ``by`` (hits,
    or a column of an attachment such as ``time.last``; ties by name) stay, and all under them. ``age``: those whose
    ``by`` is more than this below their parent's greatest go, too."""
    depth = len(below) + 1
    own = F.col("depth") == depth
    for k, n in enumerate(below):
        own = own & (F.lit(True) if n == "*" else F.get("path", F.lit(k)) == n)
    parent = F.slice("path", F.lit(1), F.lit(depth - 1))
    children = tree.nodes.filter(own).select("path", parent.alias("__parent"), "name", F.col(f"`{by}`").alias("__by"))
    order = Window.partitionBy("__parent").orderBy(F.col("__by").desc_nulls_last(), "name")
    stay = children.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= size)
    if age is not None:
        latest = children.groupBy("__parent").agg(F.max("__by").alias("__most"))
        stay = stay.join(latest, "__parent").filter(F.col("__most") - F.col("__by") <= age)
    matched = F.col("depth") >= depth
    for k, n in enumerate(below):
        matched = matched & (F.lit(True) if n == "*" else F.get("path", F.lit(k)) == n)
    kept = tree.nodes.filter(matched).withColumn("__child", F.slice("path", F.lit(1), F.lit(depth))).join(stay.select(F.col("path").alias("__child")), "__child", "left_semi").drop("__child")
    nodes = tree.nodes.filter(~matched).unionByName(kept.select(*[F.col(f"`{c}`") for c in tree.nodes.columns])).drop("depth", "name", "nodes")
    return Tree(with_children(nodes), tree.attachments, tree.of_children)


def aliased(tree: Tree, at: list[str], target: list[str]) -> Tree:
    """With the nodes under ``target`` also under ``at``, as the tree is now."""
    n = len(target)
    under = (F.col("depth") > n) & (F.slice("path", F.lit(1), F.lit(n)) == F.array(*map(F.lit, target)))
    here = F.concat(F.array(*map(F.lit, at)), F.slice("path", F.lit(n + 1), F.col("depth") - n))
    copies = tree.nodes.filter(under).withColumn("path", here)
    heads = [at[:k] for k in range(1, len(at) + 1)]
    missing = tree.nodes.sparkSession.range(1).select(F.explode(F.array(*[F.array(*map(F.lit, h)) for h in heads])).alias("path")).join(tree.nodes.select("path"), "path", "left_anti").withColumn("hits", F.lit(0).cast("long"))
    every = tree.nodes.unionByName(copies).drop("depth", "name", "nodes").unionByName(missing, allowMissingColumns=True)
    return Tree(with_children(every), tree.attachments, tree.of_children)


def looked_up(df: DataFrame, tree: Tree, path: list[tuple[str, str]], to: str, what: str = "hits") -> DataFrame:
    """``df`` with a node's ``hits``, ``nodes`` or name of children (``names``) in a new column; null where there is no
    such node. ``path``: ("const", name) or ("field", column) for each level."""
    wanted = F.array(*[F.lit(x) if kind == "const" else F.col(f"`{x}`").cast("string") for kind, x in path])
    level = tree.nodes.filter(F.col("depth") == len(path))
    if what == "names":
        below = tree.nodes.filter(F.col("depth") == len(path) + 1)
        level = below.groupBy(F.slice("path", F.lit(1), F.lit(len(path))).alias("path")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return df.withColumn("__path", wanted).join(level.select(F.col("path").alias("__path"), F.col(what).alias(to)), "__path", "left").drop("__path")


# --- path queries ----------------------------------------------------------


@dataclass
class _Level:
    text: str
    match: str = "*"
    collect: bool = False
    label: str | None = None
    limit: tuple[int, int] | None = None
    properties: list[tuple[str, bool, list[tuple[str, int]]]] = field(default_factory=list)
    data: list[tuple[str, str, bool, bool]] = field(default_factory=list)  # attachment, option, collected, size
    up: bool = False
    null_ok: bool = False  # rows stay where a property or attachment has no value
    default: tuple[str, int] | None = None  # name and hits of the node that stands where none matches


_PROPERTY = re.compile(r"(\+?)(hits|count|nodes|name|json|mem)((?:[<>=]+\d+)*)")


def _parse_level(text: str) -> _Level:
    out = _Level(text)
    rest = text
    if m := re.match(r"\((\d+)(?:-(\d+))?\)(?=.)", rest):
        out.limit = (int(m[1]), int(m[2])) if m[2] else (0, int(m[1]))
        rest = rest[m.end() :]
    if rest.startswith("~"):
        out.null_ok, rest = True, rest[1:]
    if "$" in rest and not rest.startswith("$$"):
        rest, _, data = rest.partition("$")
        for d in data.split(","):
            collected = d.startswith("+")
            d = d.lstrip("+")
            size = d.startswith("?")
            name, _, option = d.lstrip("?").partition("=")
            out.data.append((name, option, collected, size))
    if ":" in rest:
        rest, _, props = rest.partition(":")
        for p in props.split(","):
            m = _PROPERTY.fullmatch(p.strip())
            if not m:
                raise ValueError(f"no node property {p!r}")
            out.properties.append((m[2], bool(m[1]), [(a, int(b)) for a, b in re.findall(r"([<>=]+)(\d+)", m[3])]))
    if m := re.search(r"\((\d+)(?:-(\d+))?\)$", rest):
        out.limit = (int(m[1]), int(m[2])) if m[2] else (0, int(m[1]))
        rest = rest[: m.start()]
    if rest.endswith("~"):
        out.null_ok, rest = True, rest[:-1]
    if m := re.match(r"\+(%?)\[([^\]|]*)(?:\|(\d+))?\]", rest):
        out.default = (m[2], int(m[3] or 0))
        rest = f"+{m[1]}{rest[m.end() :]}"
    if m := re.search(r"\{([^}]*)\}", rest):
        out.label = m[1]
        rest = rest[: m.start()] + rest[m.end() :]
    if rest.startswith("+") and not rest.startswith("++"):
        out.collect, rest = True, rest[1:]
    elif rest.startswith("++"):
        out.collect, rest = True, "^" + rest[2:]
    if rest == "..":
        out.up = True
    out.match = rest or "*"
    return out


def _levels(path: str) -> list[_Level]:
    parts, now, depth = [], "", 0
    for k, c in enumerate(path):
        depth += (c in "{([") - (c in "})]")
        if c == "/" and depth == 0 and not now.startswith("@@") and not now.startswith("+@@"):
            parts.append(now)
            now = ""
        else:
            now += c
    return [_parse_level(p) for p in [*parts, now] if p]


def _test(match: str, name: Column) -> Column:
    if match == "*":
        return F.lit(True)
    if match[0] == "^":
        return name.startswith(match[1:])
    if match[0] == "@":
        low, _, high = match[1:].partition(",")
        test = name >= low if low else F.lit(True)
        return test & (name < high) if high else test
    if match[0] in "|!":  # several patterns: any of those after |, none of those after !
        test = F.lit(not any(p[0] == "|" for p in _patterns(match)))
        for p in _patterns(match):
            hit = name.rlike(f"^(?:{p[1:]})$")
            test = test | hit if p[0] == "|" else test
        for p in _patterns(match):
            test = test & ~name.rlike(f"^(?:{p[1:]})$") if p[0] == "!" else test
        return test
    return name.isin(_listed(match))


def _patterns(match: str) -> list[str]:
    return re.split(r",(?=[|!])", match)


def _listed(match: str) -> list[str]:
    """The names of a list, in the order in which they are asked for; [] for other levels."""
    return [x for x in match.replace(";", ",").split(",") if x] if match[0] not in "*^@|!%" else []


def _virtual(tree: Tree, name: str, option: str) -> tuple[Column, bool]:
    a = tree.attachments[name]
    if a.nodes is None:
        raise ValueError(f"attachment {name!r} has no nodes")
    return a.nodes(lambda suffix: F.col(f"`{name}.{suffix}`"), option), name in tree.of_children


def _children(tree: Tree, name: str, nodes: DataFrame, at: int, to: str, how: str) -> DataFrame:
    """``nodes`` with what an attachment keeps of the children of their part of ``at`` levels, in a column ``to``."""
    below = tree.nodes.filter(F.col("depth") == at + 1).select(F.slice("path", F.lit(1), F.lit(at)).alias("path"), "name", "hits")
    kept = tree.attachments[name].children(below).select(F.col("path").alias("__of"), F.col("children").cast(T.ArrayType(NODE)).alias(to))
    return nodes.join(kept, F.slice("path", F.lit(1), F.lit(at)) == F.col("__of"), how).drop("__of")


def _with_default(tree: Tree, nodes: DataFrame, x: _Level, depth: int) -> DataFrame:
    """The nodes that match the last level, and the default node under each parent where none does."""
    name, hits = x.default
    own = nodes.filter(_test(x.match, F.get("path", F.lit(depth - 1))))
    root = tree.nodes.sparkSession.range(1).select(F.array().cast("array<string>").alias("path"))
    parents = tree.nodes.filter(F.col("depth") == depth - 1).select("path") if depth > 1 else root
    bare = parents.join(own.select(F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path")).distinct(), "path", "left_anti")
    stand = bare.select(F.array_append("path", F.lit(name)).alias("path"), F.lit(depth).alias("depth"), F.lit(name).alias("name"), F.lit(hits).cast("long").alias("hits"), F.lit(0).cast("long").alias("nodes"))
    return own.unionByName(stand, allowMissingColumns=True)


def decoded(path: str) -> list[dict]:
    """The elements of a path as plain data."""
    return [asdict(x) for x in _levels(path)]


def encoded(elements: list[dict]) -> str:
    """The path of elements that ``decoded`` has made."""
    return "/".join(x["text"] for x in elements)


def query(tree: Tree, path: str | list[str], ops: str = "", rops: str = "") -> Rows:
    """Rows of a path query, in order of path, through ``rops`` and then ``ops``. Several paths are put together, by
    position of their columns; ``rops`` then work on each path's rows. Dates such as {{now-1}} are those of the driver's clock.
    A level is ``(skip-limit)~name:properties$attachments``; ``+[name|hits]`` stands for a last level that has no match."""
    from treeline.operators.registry import run

    if isinstance(path, list):
        parts = [query(tree, p, "", rops) for p in path]
        names = parts[0].columns
        frames = [p.plain().toDF(*names).withColumn("__k0", F.lit(k)) for k, p in enumerate(parts)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        rows = Rows(out, names, (("__k0", True),))
        return run(rows, ops) if ops else rows

    levels = _levels(expanded(path))
    places: list[Column] = []  # the sort key of each level: the name, or its place in a list
    virtual = None
    if levels and levels[-1].match.startswith("%"):
        virtual = levels.pop()
    tree = tree.reading({d[0] for x in levels for d in x.data} | ({virtual.match[1:].partition("=")[0]} if virtual else set()))
    depth = len([x for x in levels if not x.up])
    nodes = tree.nodes.filter(F.col("depth") == depth)
    if any(x.default and (x is not levels[-1] or x.match[:2] == "@@") for x in levels):
        raise ValueError("a default stands for a last level of names")
    if levels and levels[-1].default:
        nodes = _with_default(tree, nodes, levels[-1], depth)
    at = 0
    columns: dict[str, Column] = {}

    def label(wanted: str | None, default: str) -> str:
        name, k = wanted or default, 1
        while name in columns:
            name, k = f"{wanted or default}_{k}", k + 1
        return name

    for x in levels:
        if x.up:
            if x.collect:
                columns[label(x.label, "parent")] = F.get("path", F.lit(at - 2))
            continue
        at += 1
        name = F.get("path", F.lit(at - 1))
        listed = _listed(x.match) if not x.up else []
        places.append(F.lpad(F.array_position(F.array(*map(F.lit, listed)), name).cast("string"), 9, "0") if len(listed) > 1 else name)
        if x.match.startswith("@@"):
            other = [p for p in x.match[2:].split("/") if p]
            inside = tree.nodes.filter(F.col("depth") == len(other) + 1)
            for k, p in enumerate(other):
                inside = inside.filter(_test(p, F.get("path", F.lit(k))))
            nodes = nodes.withColumn("__n", name).join(inside.select(F.col("name").alias("__n")).distinct(), "__n", "left_semi").drop("__n")
        elif not x.default:
            nodes = nodes.filter(_test(x.match, name))
        if x.limit:
            parent = Window.partitionBy(F.slice("path", F.lit(1), F.lit(at - 1))).orderBy(name)
            nodes = nodes.withColumn("__r", F.dense_rank().over(parent)).filter(F.col("__r").between(x.limit[0] + 1, sum(x.limit))).drop("__r")
        if x.collect:
            columns[label(x.label, f"c{len(columns)}")] = name
        if (x.properties or x.data) and at < depth:
            inner = tree.nodes.filter(F.col("depth") == at)
            inner = inner.select(F.col("path").alias("__up"), *[F.col(f"`{c}`").alias(f"__{at}_{c}") for c in inner.columns if c != "path"])
            nodes = nodes.join(inner, F.slice("path", F.lit(1), F.lit(at)) == F.col("__up")).drop("__up")
            nodes = _read(tree, nodes, x, f"__{at}_", at, columns, label)
        elif x.properties or x.data:
            nodes = _read(tree, nodes, x, "", at, columns, label)
    if virtual is not None:
        name, _, option = virtual.match[1:].partition("=")
        listed, of_children = _virtual(tree, name, option)
        if of_children:
            nodes = _children(tree, name, nodes, depth, f"{name}.children", "left" if virtual.default else "inner")
        if virtual.default:
            stand = F.array(F.struct(F.lit(virtual.default[0]).alias("name"), F.lit(virtual.default[1]).cast("long").alias("hits")))
            listed = F.when(F.size(listed) > 0, listed).otherwise(stand)
        nodes = nodes.select("*", F.posexplode(listed).alias("__at", "__v"))
        if virtual.collect:
            columns[label(virtual.label, f"c{len(columns)}")] = F.col("__v.name")
        for prop, collected, tests in virtual.properties:
            value = F.col("__v.hits")
            nodes = _bounded(nodes, value, tests)
            if collected:
                columns[label(None, prop)] = value
        out = nodes.select(*[c.alias(n) for n, c in columns.items()], F.array(*places).alias("__k0"), F.col("__at").alias("__k1"))
        rows = Rows(out, tuple(columns), (("__k0", True), ("__k1", True)))
    else:
        out = nodes.select(*[c.alias(n) for n, c in columns.items()], F.array(*places).alias("__k0"))
        rows = Rows(out, tuple(columns), (("__k0", True),))
    rows = run(rows, rops) if rops else rows
    return run(rows, ops) if ops else rows


def _bounded(nodes: DataFrame, value: Column, tests: list[tuple[str, int]]) -> DataFrame:
    """Bounds are alternatives: a node stays if it meets any of them."""
    return nodes.filter(_within(value, tests)) if tests else nodes


def _within(value: Column, tests: list[tuple[str, int]]) -> Column:
    keep = F.lit(not tests)
    for sign, n in tests:
        keep = keep | {">": value > n, "<": value < n, "=": value == n, ">=": value >= n, "<=": value <= n}[sign]
    return keep


def _read(tree: Tree, nodes: DataFrame, x: _Level, prefix: str, at: int, columns: dict[str, Column], label) -> DataFrame:
    """Rows that a bound refuses go, or stay with null where nulls are allowed; so do rows without an attachment's value
    that isn't collected. Collected values may be null."""
    get = lambda c: F.col(f"`{prefix}{c}`")
    for prop, collected, tests in x.properties:
        value = {"hits": lambda: get("hits"), "count": lambda: get("hits"), "nodes": lambda: get("nodes"), "name": lambda: get("name"), "mem": lambda: F.lit(0).cast("long"), "json": lambda: F.to_json(F.struct(get("name").alias("name"), get("hits").alias("hits"), get("nodes").alias("nodes")))}[prop]()
        if x.null_ok:
            value = F.when(_within(value, tests), value)
        else:
            nodes = _bounded(nodes, value, tests)
        if collected:
            columns[label(x.label if not x.collect else None, prop)] = value
    for name, option, collected, size in x.data:
        a = tree.attachments[name]
        if name in tree.of_children:
            own = f"{prefix}{name}.children"
            nodes = nodes if own in nodes.columns else _children(tree, name, nodes, at, own, "left")
        buffers = [c for c in tree.nodes.columns if c.startswith(f"{name}.")]
        if size:
            value = sum((F.length(F.to_json(F.struct(get(b)))) for b in buffers[1:]), F.length(F.to_json(F.struct(get(buffers[0])))))
        else:
            value = a.value(lambda suffix, n=name: get(f"{n}.{suffix}"), option)
        if collected:
            columns[label(None, f"{name}_{option}" if option else name)] = value
        elif not x.null_ok:
            nodes = nodes.filter(value.isNotNull())
    return nodes
