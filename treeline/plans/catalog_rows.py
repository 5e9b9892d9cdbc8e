"""Registered queries of filters, formats, path elements and series that the first catalogue doesn't use.

Where a result is a small fixed table, its SQL lists the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.sketches import in_bloom
from treeline.functions.value_filters import Value, filtered
from treeline.operators.registry import run
from treeline.plans import tree as trees
from treeline.plans.catalog import BY_KEY, ORDERS, O, bundles, ops, query, table, values
from treeline.plans.rows import Rows
from treeline.plans.storage import shared_dir
from treeline.sources.read import bundled, read
from treeline.sources.write import encoded, write

# --- fixed tables ---


def fixed(name: str, data: str, pipeline: str, expected: str, kinds: str) -> None:
    """A pipeline over rows given as text: rows between /, cells between spaces, _ is null, '' the empty text. ``kinds``: the type of each expected column."""

    def cells(text: str) -> list[list[str | None]]:
        return [[None if c == "_" else "" if c == "''" else c for c in row.split()] for row in text.split("/")]

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = cells(data)
        width = max(map(len, given))
        names = [f"c{k}" for k in range(width)]
        df = spark.createDataFrame([(k, *r, *[None] * (width - len(r))) for k, r in enumerate(given)], "__k0 int, " + ", ".join(f"{n} string" for n in names))
        out = run(Rows(df, tuple(names), (("__k0", True),)), pipeline).numbered()
        shown = out.df.select(F.col("__n").alias("place"), *[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(out.columns)])
        return shown

    types = kinds.split()
    lines = []
    for place, row in enumerate(cells(expected)):
        own = ", ".join(("NULL" if c is None else "'" + c + "'") + f"::{t}" for c, t in zip(row, types, strict=True))
        lines.append(f"({place}::BIGINT, {own})")
    query(name, f"SELECT * FROM (VALUES {', '.join(lines)}) AS t(place, {', '.join(f'x{k}' for k in range(len(types)))})")(go)


S, L, D = "VARCHAR", "BIGINT", "DOUBLE"
PETS = "cat a 1 2 / cat b 2 3 / cat c 3 4 / dog a 6 0 / dog b 7 1 / dog c 8 0"
PAIRS = "cat a 1 / cat b 2 / cat b 3 / cat a 3 / dog a 6 / dog a 8 / dog b 7 / dog b 8"
fixed("golden_merge", PAIRS, "merge=kisu", "cat 9 4 / dog 29 4", f"{S} {L} {L}")
fixed("golden_merge_runs", PAIRS, "merge=kksu", "cat a 1 1 / cat b 5 2 / cat a 3 1 / dog a 14 2 / dog b 15 2", f"{S} {S} {L} {L}")
fixed("golden_roll_sum", PETS, "sum=2,3", "cat a 1 2 1 2 / cat b 2 3 3 5 / cat c 3 4 6 9 / dog a 6 0 12 9 / dog b 7 1 19 10 / dog c 8 0 27 10", f"{S} {S} {S} {S} {L} {L}")
fixed("golden_roll_in_place", PETS, "sum=s2,3", "cat a 1 2 / cat b 3 5 / cat c 6 9 / dog a 12 9 / dog b 19 10 / dog c 27 10", f"{S} {S} {L} {L}")
fixed("golden_roll_summary", PETS, "sum=S2,3", PETS + " / _ _ 27 10", f"{S} {S} {S} {S}")
fixed("golden_roll_null", "cat a 1 2 _ / cat b 2 3 _ / cat c 3 4 3 / dog a 6 0 _ / dog b 7 1 2 / dog c 8 0 _", "sum=4", "cat a 1 2 _ 0 / cat b 2 3 _ 0 / cat c 3 4 3 3 / dog a 6 0 _ 3 / dog b 7 1 2 5 / dog c 8 0 _ 5", f"{S} {S} {S} {S} {S} {L}")
fixed("golden_roll_min", PETS, "min=3:0", "cat a 1 2 2 / cat b 2 3 2 / cat c 3 4 2 / dog a 6 0 0 / dog b 7 1 0 / dog c 8 0 0", f"{S} {S} {S} {S} {L}")
fixed("golden_depivot", "index a b _ / aaa 1 3 4 / bbb 2 2 4 / ccc 3 1 4", "depivot=row,col,val", "aaa a 1 / aaa b 3 / bbb a 2 / bbb b 2 / ccc a 3 / ccc b 1", f"{S} {S} {S}")
fixed("golden_depivot_extra", "index a b _ / aaa 1 3 1 / bbb 2 2 2 / ccc 3 1 1", "depivot=row,col,val,extra;order=row,col,val,extra", "aaa a 1 1 / aaa b 3 1 / bbb a 2 2 / bbb b 2 2 / ccc a 3 1 / ccc b 1 1", f"{S} {S} {S} {S}")
fixed("golden_fold", PETS, "fold=0:1:a,b,c:2,3", "cat 1 2 2 3 3 4 / dog 6 0 7 1 8 0", f"{S} {S} {S} {S} {S} {S} {S}")
fixed("golden_groupby_limit", PAIRS, "groupby=k:limit=2", "cat a 1 / cat b 2 / dog a 6 / dog a 8", f"{S} {S} {S}")
fixed("golden_groupby_range", PAIRS, "groupby=k:range=1,3", "cat b 2 / cat b 3 / dog a 8 / dog b 7", f"{S} {S} {S}")
fixed("golden_groupby_running", "a 1 / b 5 / a 2 / b 6 / a 3", "groupby=k:sum=1", "a 1 1 / b 5 5 / a 2 3 / b 6 11 / a 3 6", f"{S} {S} {L}")
fixed("golden_groupby_pipeline", PAIRS, "groupby=kk:limit=1%3Bcompare=2:geq:2", "cat b 2 / dog a 6 / dog b 7", f"{S} {S} {S}")
fixed("golden_histo2_int", "A 1 x / B 2 x / C 3 x / D 4 x / E 5 x", "histo2=1,2,4", "-2147483648 1 / 2 2 / 4 2", f"{L} {L}")
fixed("golden_distribution", "a 0 / b 1 / c 2 / d 3 / e 4", "distribution=1,5", "0.5 2.0 / 0.75 3.5 / 0.95 4.0 / 0.98 4.0 / 0.99 4.0 / 0.999 4.0", f"{D} {D}")
fixed("golden_percentrank", "a 1 / b 6 / c 4 / d 2", "percentrank=1:2;order=1,2;sort=0:n:a", "1 0.25 / 2 0.5 / 4 0.75 / 6 1.0", f"{S} {D}")
fixed("golden_rmsing", "key1 val1 xxx / key1 val1 yyy / key1 val1 zzz / key2 val1 aaa / key2 val2 bbb / key2 val2 ccc", "rmsing=0:1", "key2 val1 aaa / key2 val2 bbb / key2 val2 ccc", f"{S} {S} {S}")
fixed("golden_transpose", "a b c d / e f g h / i j k l", "trans", "a e i / b f j / c g k / d h l", f"{S} {S} {S}")
fixed("golden_sort_mixed", "0 A 3 / 0 A 5 / 1 A 1 / 1 B 2", "sort=0,1,2:nsn:add", "0 A 5 / 0 A 3 / 1 B 2 / 1 A 1", f"{S} {S} {S}")
fixed("golden_sort", "3 A / 2 B / 4 C / 1 X", "sort", "1 X / 2 B / 3 A / 4 C", f"{S} {S}")
fixed("golden_compare", "S 7 / M 5 / F 4", "compare=1:geq:5", "S 7 / M 5", f"{S} {S}")
fixed("golden_contains", "aab 1 / bab 2 / cba 3", "contains=0:ab", "aab 1 / bab 2", f"{S} {S}")
fixed("golden_num_rem", "A 1 x / B 2 x / C 3 x / D 4 x", "num=n5,c1,rem,v2,set", "A 1 0 / B 2 1 / C 3 2 / D 4 1", f"{S} {S} {L}")
fixed("golden_num_cap", "0 / 5 / 6 / 0", "num=c0,v1,maxif,v0,set", "0 / 1 / 1 / 0", L)
fixed("golden_num_floor", "5 / 2 / 3 / 5", "num=c0,v4,minif,v0,set", "5 / 4 / 4 / 5", L)
fixed("golden_str", "k1:v1 / k2:v2 / k3:v3", "str=c0,v:,v0,split,v0,set", "k1 / k2 / k3", S)
fixed("golden_fill", "cat a 1 2 / dog a _ _", "fill=0", "cat a 1 2 / dog a 0 0", f"{S} {S} {S} {S}")
fixed("golden_diff", "cat a 1 / cat b 2 / cat a 3 / cat b 3 / dog a 6 / dog b 7 / dog a 8 / dog b 8 / dog b 9 / dog b 4 / dog a 2 / dog b 3 / dog a 6 / dog a 8 / foo a 3 / bar a 3", "diff=kad", "cat '' 1 / cat '' 0 / dog '' 1 / dog '' 0 / dog + 9 / dog + 4 / dog '' 1 / dog '' 2 / foo - -3", f"{S} {S} {L}")
fixed("golden_changepoints", "MONDAY 10 / TUESDAY 10 / WEDNESDAY 10 / THURSDAY 1000 / FRIDAY 10 / SATURDAY 10", "changepoints=0:1", "THURSDAY PEAK 990", f"{S} {S} {L}")
fixed("num_bits", "1 / 2 / -4", "num=c0,tof,tob,dup,v1,set,btof,v2,set;order=1,2", "4607182418800017408 1.0 / 4611686018427387904 2.0 / -4607182418800017408 -4.0", f"{L} {D}")
fixed("num_roots", "1 / 100 / 10000", "num=c0,log,v1,set,c0,sqrt,v2,set,n0,c0,-,abs,v3,set;order=1,2,3", "0.0 1.0 1.0 / 2.0 10.0 100.0 / 4.0 100.0 10000.0", f"{D} {D} {D}")
fixed("num_stack", "7 2 / 9 4", "num=c0,dup,*,v2,set,c0,c1,swap,-,v3,set,c0,c1,pop,v4,set;order=2,3,4", "49 -5 7 / 81 -5 9", f"{L} {L} {L}")
fixed("num_mean_variance", "a", "num=n2:3:5:7:11:13:17:19,mean,v1,set,n2:3:5:7:11:13:17:19,variance,v2,set;order=1,2", "9.625 35.734375", f"{D} {D}")
fixed("num_division_checked", "9 2 / 8 4", "num=diverr,c0,c1,/,v2,set,c0,c1,rem,v3,set;order=2,3", "4 1 / 2 0", f"{L} {L}")

# --- value filters ---

values(
    "filters_plain", "nation", ["n_nationkey"],
    {
        "trimmed": ("concat('  ', n_name, ' ')", "trim"), "fixed": ("n_name", {"op": "set", "value": "x"}), "same": ("n_name", "pass"), "bare": ("if(n_nationkey % 2 = 0, '', n_name)", {"op": "empty"}),
        "full": ("if(n_nationkey % 2 = 0, '', n_name)", {"op": "empty", "not": True}), "cached": ("n_name", {"op": "cache", "value": "Ab", "filter": "case"}), "each": ("split(n_name, '')", {"op": "list-apply", "filter": "case"}),
        "picked": ("concat('a=', n_nationkey, ',b=', n_name)", ["create-map", {"op": "map-value", "key": "b"}]), "subset": ("concat('a=', n_nationkey, ',b=', n_name)", ["create-map", {"op": "map-subset", "whitelist": ["a"], "toString": True}]),
        "others": ("concat('a=', n_nationkey, ',b=x')", ["create-map", {"op": "map-subset", "blacklist": ["a"], "toString": True}]), "shown": ("concat('{\"k\":\"', n_nationkey, '\"}')", [{"op": "json", "schema": "map<string,string>"}, "pretty-print"]),
        "drawn": ("n_name", {"op": "random", "max": 1}), "never": ("n_name", [{"op": "require", "match": "no such name"}, "error"]), "tags": ("concat('<a href=\"/', n_name, '\">/x</a><b href=\"/\">')", [{"op": "grepTags", "tagName": "a", "tagAttrs": ["href"], "values": ["/"]}, {"op": "map-value", "key": "/"}]),
        "put": ("concat('a=', n_nationkey)", ["create-map", {"op": "map-value", "key": "b", "put": "y"}, {"op": "join", "sort": True}]),
    },
    """SELECT n_nationkey, n_name AS trimmed, 'x' AS fixed, n_name AS same, CASE WHEN n_nationkey % 2 = 0 THEN '' END AS bare, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS full, 'ab' AS cached,
    list_transform(string_split(n_name, ''), lambda x: lower(x)) AS each, n_name AS picked, '{"a":"' || n_nationkey || '"}' AS subset, '{"b":"x"}' AS others, '{"k":"' || n_nationkey || '"}' AS shown, 0::BIGINT AS drawn, NULL::VARCHAR AS never, 1::INTEGER AS tags,
    'a=' || n_nationkey || ',b=y' AS put FROM nation""",
)


@query("golden_hash", "SELECT * FROM (VALUES ('128.0.0.1', 1407168586::BIGINT, '9c678c09e0163cb9f0bdaf0363047ac5b549704e')) AS t(v, murmur, sha)")
def golden_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Value(F.col("v"))
    return spark.range(1).select(F.lit("128.0.0.1").alias("v")).select("v", filtered(v, {"op": "hash", "type": 1, "abs": True}).c.cast("bigint").alias("murmur"), filtered(v, {"op": "hash", "type": 4}).c.alias("sha"))


@query("golden_java_hash", "SELECT n_nationkey, n_name, h FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS u FROM nation), LATERAL (SELECT CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h)")
def golden_java_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", filtered(Value(F.col("n_name")), {"op": "hash", "type": 0}).c.cast("bigint").alias("h"))


@query("filter_seen", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%')")
def filter_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    known = run(Rows.of(orders.filter("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%'").select("o_orderpriority")), "seen=0").plain().first()[0]  # one filter
    return orders.select("o_orderkey", filtered(Value(F.col("o_orderpriority")), {"op": "seen", "bloom": known}).c.alias("o_orderpriority")).filter("o_orderpriority IS NOT NULL")


@query("attachment_bloom_sized", "SELECT 'all' AS c0, count(DISTINCT o_custkey) AS held, true AS few FROM orders")
def attachment_bloom_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter sized for its values holds them all, and few of as many others."""
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    tree = trees.built(orders, [{"const": "all", "data": {"b": {"type": "bloom", "key": "o_custkey", "max": 100_000, "error": 0.01}}}])
    bloom = tree.nodes.select(F.col("`b.bits`").alias("bits"))  # one row
    asked = orders.distinct().select("o_custkey").unionAll(orders.distinct().select(-F.col("o_custkey") - 1)).crossJoin(F.broadcast(bloom))
    passed = asked.filter(in_bloom(F.col("bits"), F.col("o_custkey"), 4))
    counts = passed.agg(F.count_if(F.col("o_custkey") >= 0).alias("held"), F.count_if(F.col("o_custkey") < 0).alias("wrong"))
    return counts.select(F.lit("all").alias("c0"), "held", (F.col("wrong") <= 0.03 * F.col("held")).alias("few"))


@query("filter_eval", "SELECT n_nationkey, n_name || '!' AS loud FROM nation")
def filter_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", filtered(Value(F.col("n_name")), {"op": "python", "body": lambda v: v + "!"}).c.alias("loud"))


# --- bundle filters ---

F_ONLY = {"op": "field", "from": "status", "filter": {"op": "require", "value": "F"}, "test": True}
bundles("bundle_clear", "orders", ORDERS[:3], {"op": "clear", "field": "status"}, "SELECT o_orderkey, o_custkey, NULL::VARCHAR AS status FROM orders")
bundles("bundle_contains", "orders", ORDERS, {"op": "contains", "field": "priority", "value": ["URG", "LOW"]}, f"SELECT * FROM {O} WHERE priority LIKE '%URG%' OR priority LIKE '%LOW%'")
bundles("bundle_defaults", "orders", ["o_orderkey", "nullif(o_orderstatus, 'F') as status"], [{"op": "defaults", "default": {"status": "f"}}, {"op": "debug"}], "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'f') AS status FROM orders")
bundles("bundle_error", "orders", ORDERS, [{"op": "field", "from": "status", "filter": {"op": "require", "value": "no such status"}}], f"SELECT * FROM {O} WHERE false")
bundles("bundle_foreach", "orders", ["o_orderkey", "split(o_orderpriority, '-') as p"], {"op": "foreach", "field": "p", "filter": "case"}, "SELECT o_orderkey, list_transform(string_split(o_orderpriority, '-'), lambda x: lower(x)) AS p FROM orders")
bundles("bundle_map", "orders", ORDERS, {"op": "map", "fields": [{"from": "priority", "filter": "case", "to": "low"}, {"from": "status", "filter": {"op": "exclude", "value": ["P"]}}], "exitFail": True}, f"SELECT *, lower(priority) AS low FROM {O} WHERE status <> 'P'")
bundles("bundle_map_extract", "orders", ["o_orderkey", "map('s', o_orderstatus, 'p', o_orderpriority) as m"], [{"op": "map-extract", "field": "m", "map": [{"from": "s", "to": "status"}, {"from": "x", "to": "nothing"}]}, {"op": "clear", "field": "m", "removes": True}], "SELECT o_orderkey, o_orderstatus AS status, NULL::VARCHAR AS nothing FROM orders")
bundles("bundle_not", "orders", ["o_orderkey", "nullif(o_orderstatus, 'F') as status"], {"op": "not", "field": "status"}, "SELECT o_orderkey, NULL::VARCHAR AS status FROM orders WHERE o_orderstatus = 'F'")
bundles("bundle_random_field", "orders", ["o_orderkey", "o_orderstatus as a", "cast(null as string) as b"], {"op": "random-field", "inFields": ["a", "b"], "out": "c"}, "SELECT o_orderkey, o_orderstatus AS a, NULL::VARCHAR AS b, o_orderstatus AS c FROM orders")
bundles("bundle_recent1", "events", ["event_id", "user_id", "event_id * 10 as at"], {"op": "recent1", "key": "user_id", "time": "at", "out": "gap", "sample": 2}, "SELECT event_id, user_id, event_id * 10 AS at, (event_id * 10 - lag(event_id * 10) OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE AS gap FROM events")
bundles("bundle_template", "orders", ORDERS[:3], {"op": "template", "template": "{{status}}-{{o_custkey}}!", "to": "t"}, "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderstatus || '-' || o_custkey || '!' AS t FROM orders")
bundles("bundle_test", "orders", ORDERS, {"op": "test", "test": F_ONLY, "onTrue": {"op": "field", "from": "priority", "filter": "case"}, "onFalse": {"op": "field", "from": "priority", "filter": {"op": "require", "contains": "URG"}}}, f"SELECT * REPLACE (CASE WHEN status = 'F' THEN lower(priority) ELSE priority END AS priority) FROM {O} WHERE status = 'F' OR priority LIKE '%URG%'")
bundles("bundle_time", "orders", ["o_orderkey", "cast(unix_millis(cast(o_orderdate as timestamp)) as string) as at"], {"op": "time", "src": {"field": "at"}, "dst": {"field": "day", "format": "yyMMdd"}}, "SELECT o_orderkey, epoch_ms(o_orderdate)::VARCHAR AS at, strftime(o_orderdate, '%y%m%d') AS day FROM orders")
bundles("bundle_try", "orders", ORDERS, {"op": "try", "try": F_ONLY, "catch": {"op": "value", "to": "priority", "value": "caught"}}, f"SELECT * REPLACE (CASE WHEN status = 'F' THEN priority ELSE 'caught' END AS priority) FROM {O}")
bundles("bundle_unary", "orders", ORDERS, [{"op": "unary", "operation": "negate", "filter": F_ONLY}, {"op": "true"}], f"SELECT * FROM {O} WHERE status <> 'F'")
bundles("bundle_false", "orders", ORDERS, {"op": "false"}, f"SELECT * FROM {O} WHERE false")
bundles("bundle_safely", "orders", ORDERS, [{"op": "safely", "filter": F_ONLY}, {"op": "ignore", "filter": {"op": "field", "from": "priority", "filter": "case"}}], f"SELECT * REPLACE (lower(priority) AS priority) FROM {O}")
bundles("bundle_then_fail", "orders", ORDERS, {"op": "try", "try": {"op": "then fail", "filter": {"op": "value", "to": "status", "value": "seen"}}, "catch": {"op": "true"}}, f"SELECT * REPLACE ('seen' AS status) FROM {O}")
bundles("bundle_is", "orders", ORDERS, {"op": "is", "filter": F_ONLY}, f"SELECT * FROM {O} WHERE status = 'F'")
bundles("bundle_is_not", "orders", ORDERS, [{"op": "is not", "filter": F_ONLY}, {"op": "isn't", "filter": {"op": "contains", "field": "priority", "value": "URG"}}, {"op": "invert", "filter": {"op": "false"}}], f"SELECT * FROM {O} WHERE status <> 'F' AND priority NOT LIKE '%URG%'")
bundles("bundle_is_null", "orders", ["o_orderkey", "nullif(o_orderstatus, 'F') as status"], {"op": "is-null-or-empty", "from": "status"}, "SELECT o_orderkey, NULL::VARCHAR AS status FROM orders WHERE o_orderstatus = 'F'")
bundles("bundle_set", "orders", ORDERS, {"op": "safely", "filter": {"op": "set", "to": "priority", "value": "done", "filter": F_ONLY}}, f"SELECT * REPLACE (CASE WHEN status = 'F' THEN 'done' ELSE priority END AS priority) FROM {O}")
bundles("bundle_wrap", "orders", ORDERS, {"op": "wrap", "filter": {"op": "set", "to": "status", "value": "f", "filter": F_ONLY}}, f"SELECT * REPLACE ('f' AS status) FROM {O} WHERE status = 'F'")
bundles("bundle_limit_by_key", "orders", ORDERS[:3], {"op": "limit-cms", "keyFields": ["status"], "valueField": "o_custkey", "limit": 2}, "SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) <= 2", order=BY_KEY)
bundles("bundle_limit_lower", "orders", ORDERS[:2], {"op": "limit-cms", "keyFields": "o_custkey", "limit": 3, "bound": "LOWER"}, "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 3", order=BY_KEY)
bundles("bundle_sieve", "orders", ORDERS[:2], {"op": "field", "from": "o_custkey", "filter": {"op": "key-sieve", "tiers": 2}}, "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 2", order=BY_KEY)
ops("filter_op", "orders", ORDERS, 'filter={"op":"field","from":"status","filter":{"op":"require","value":"O"}};limit=9', f"SELECT * FROM {O} WHERE status = 'O' ORDER BY o_orderkey LIMIT 9", order=BY_KEY)

# --- line formats, sources, sinks ---


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(f"{text} AS value", "n_nationkey")


@query("lines_kv", "SELECT n_name AS name, n_regionkey::VARCHAR AS region, NULL::VARCHAR AS none, n_nationkey FROM nation")
def lines_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundled(_lines(spark, sf_dir, "concat('name=', n_name, '&region=', n_regionkey)"), "kv", ["name", "region", "none"])


@query("lines_query", "SELECT n_name || ' & more' AS name, n_nationkey FROM nation")
def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundled(_lines(spark, sf_dir, "concat('name=', url_encode(concat(n_name, ' & more')), '&x=1')"), "query", ["name"])


@query("lines_regex", "SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS digits, n_name AS rest, n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def lines_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundled(_lines(spark, sf_dir, "if(n_nationkey % 2 = 0, concat(lpad(n_nationkey, 2, '0'), ' ', n_name), n_name)"), "regex", pattern=r"(?<digits>\d+) (?<rest>.*)")


@query("lines_noop", "SELECT n_name AS line, n_nationkey FROM nation WHERE n_name LIKE '%A%'")
def lines_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundled(_lines(spark, sf_dir, "n_name"), "noop", ["line"], lineFilter={"op": "require", "contains": "A"})


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("source_json", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    write(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), {"type": "file", "path": path, "format": "json"})
    return read(spark, {"type": "json", "files": path}).select("n_name", "n_nationkey")


@query("source_gson", "SELECT n_name, n_nationkey::DOUBLE AS n_nationkey FROM nation")
def source_gson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "gson")
    one = table(spark, sf_dir, "nation").select(F.to_json(F.array(F.struct("n_name", "n_nationkey"))).alias("value"))
    one.repartition(25, "value").write.option("maxRecordsPerFile", 1).text(path)
    return read(spark, {"type": "gson", "files": path}).select("n_name", "n_nationkey")


@query("source_files_kept_apart", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_files_kept_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink behind a filter, chained with one that keeps nothing, and the files read again."""
    path = _folder(spark, "kept")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus"))
    sink = {"type": "filtered", "filter": {"op": "field", "from": "o_orderstatus", "filter": {"op": "require", "value": "F"}}, "output": {"type": "file", "path": path, "format": "json"}}
    write(rows, {"type": "chain", "outputs": [sink, {"type": "empty"}]})
    return read(spark, {"type": "json", "files": path, "schema": "o_orderkey long, o_orderstatus string"})


@query("encoded_tsv", "SELECT n_name || chr(9) || n_regionkey AS value FROM nation")
def encoded_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string")), "tsv2").select("value")


@query("source_query", "SELECT o_orderpriority AS c0, count(*) AS hits FROM orders GROUP BY 1")
def source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = trees.built(table(spark, sf_dir, "orders"), [{"field": "o_orderpriority"}])
    return read(spark, {"type": "query", "tree": tree, "path": "+:+hits"})


# --- path elements and levels ---


@query("tree_keyop", "SELECT path, count(*) AS hits FROM (SELECT [o_orderstatus] AS path FROM orders UNION ALL SELECT [o_orderstatus, lower(o_orderpriority)] FROM orders UNION ALL SELECT [o_orderstatus, lower(o_orderpriority), 'x'] FROM orders) GROUP BY path")
def tree_keyop(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = [{"field": "o_orderstatus"}, {"keyop": [{"op": "field", "from": "o_orderpriority", "filter": "case"}, {"op": "value", "to": "o_orderstatus", "value": "x"}]}, {"op": "none"}, {"call": "low"}]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return trees.built(orders, elements, named={"low": ["o_orderpriority", {"debug": "x"}, "o_orderstatus"]}).nodes.select("path", "hits")


@query(
    "tree_value_options",
    "WITH o AS (SELECT lower(o_orderstatus) AS s, o_orderpriority AS p FROM orders) SELECT path, sum(n)::BIGINT AS hits FROM (SELECT [s] AS path, 1 AS n FROM o UNION ALL SELECT [s, s], 1 FROM o UNION ALL SELECT [s, s, 'x'], 1 FROM o UNION ALL SELECT [s, s, p], 0 FROM o) GROUP BY path",
)
def tree_value_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = [[{"field": "fixed", "term": True}, "o_orderkey"], [{"field": "o_orderpriority", "count": False}]]
    elements = [{"field": "o_orderstatus", "vfilter": "case", "set": "low"}, {"const": "x", "op": True, "set": "fixed"}, {"field": "low"}, {"branch": branches}]
    return trees.built(table(spark, sf_dir, "orders"), elements).nodes.select("path", "hits")


@query("filter_split_map", "SELECT r_regionkey, 'b=' || r_name AS last, 'flag' AS alone, upper(substr(r_name, 1, 1)) AS first, 3 AS n FROM region")
def filter_split_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal keys the last counts, values keep further signs, a part without the sign is key and value."""
    text = F.concat(F.lit("A=x;flag;a=b="), "r_name", F.lit(";C="), F.substring("r_name", 1, 1))
    found = filtered(Value(text, T.StringType()), {"op": "split", "split": ";", "keySplit": "=", "keyFilter": "case"}).c
    df = table(spark, sf_dir, "region").select("r_regionkey", found.alias("m"))
    return df.select("r_regionkey", F.col("m")["a"].alias("last"), F.col("m")["flag"].alias("alone"), F.col("m")["c"].alias("first"), F.size("m").alias("n"))


def _status_tree(spark: SparkSession, sf_dir: str, data: dict | None = None) -> trees.Tree:
    return trees.built(table(spark, sf_dir, "orders"), [{"field": "o_orderpriority"}, {"field": "o_orderstatus", "data": data or {}}])


@query("path_listed_order", "SELECT k - 1 AS place, s AS c0, n AS hits FROM (VALUES (1::BIGINT, '5-LOW'), (2::BIGINT, '1-URGENT')) AS t(k, s) JOIN (SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY 1) USING (s)")
def path_listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees.query(_status_tree(spark, sf_dir), "+5-LOW,1-URGENT:+hits").numbered()
    return rows.df.select(F.col("__n").alias("place"), "c0", "hits")


@query("path_patterns", "SELECT o_orderpriority AS c0, count(*) AS hits FROM orders WHERE (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%') GROUP BY 1")
def path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.query(_status_tree(spark, sf_dir), "+|1.*,|5.*,!3.*:+hits").plain()


@query("attachment_sumf", "SELECT o_orderpriority AS c0, o_orderstatus AS c1, sum(o_custkey)::DOUBLE AS k FROM orders GROUP BY ALL")
def attachment_sumf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.query(_status_tree(spark, sf_dir, {"k": {"type": "sumf", "key": "o_custkey"}}), "+/+$+k").plain()


@query("attachment_quantiles", "SELECT o_orderpriority AS c0, o_orderstatus AS c1, quantile_disc(o_custkey::DOUBLE, 0.5) AS d_median, max(o_custkey)::DOUBLE AS d_max, min(o_custkey)::DOUBLE AS d_min, max(o_custkey)::DOUBLE AS top FROM orders GROUP BY ALL")
def attachment_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _status_tree(spark, sf_dir, {"d": {"type": "distribution", "key": "o_custkey"}, "t": {"type": "tdigest", "key": "o_custkey"}})
    return trees.query(tree, "+/+$+d=median,+d=max,+d=min,+t=quantile(1)").plain().toDF("c0", "c1", "d_median", "d_max", "d_min", "top")


@query("attachment_estimates", "SELECT o_orderpriority AS c0, o_orderstatus AS c1, true AS near, count(*)::BIGINT AS total FROM orders GROUP BY ALL")
def attachment_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HyperLogLog count lies within three percent of the exact one; the sketch of counts knows its total."""
    tree = _status_tree(spark, sf_dir, {"hll": {"type": "count", "key": "o_custkey"}, "exact": {"type": "count", "key": "o_custkey", "ver": "exact"}, "cms": {"type": "count.min.sketch", "key": "o_orderpriority"}})
    rows = trees.query(tree, "+/+$+hll,+exact,+cms=total").plain().toDF("c0", "c1", "hll", "exact", "total")
    return rows.select("c0", "c1", (F.abs(F.col("hll") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("near"), F.col("total").cast("bigint").alias("total"))


@query("attachment_reservoir", "SELECT o_orderstatus AS c0, y::VARCHAR AS c1, count(*) AS hits FROM (SELECT o_orderstatus, year(o_orderdate) AS y FROM orders) GROUP BY o_orderstatus, y QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY y DESC) <= 3 AND y > max(y) OVER (PARTITION BY o_orderstatus) - 3")
def attachment_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("epoch", F.year("o_orderdate").cast("long"))
    tree = trees.built(orders, [{"field": "o_orderstatus", "data": {"r": {"type": "reservoir", "epochField": "epoch", "size": 3}}}])
    return trees.query(tree, "+/+%r:+hits").plain()



@query("path_default", "WITH n AS (SELECT o_orderpriority AS p, count(*) AS hits FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 7 = 0 AND o_custkey < 300 GROUP BY 1) SELECT p AS c0, coalesce(n.p IS NOT NULL, false) AS found, CASE WHEN n.p IS NULL THEN 'none' ELSE 'P' END AS c1, coalesce(n.hits, 7) AS hits FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey % 7 = 0 AND o_custkey < 300) LEFT JOIN n USING (p)")
def path_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no node matches, the default stands."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 7 = 0 AND o_custkey < 300")
    rows = trees.query(trees.built(orders, ["o_orderpriority", "o_orderstatus"]), "+/+[none|7]P:+hits").plain()
    return rows.select("c0", (F.col("c1") != "none").alias("found"), "c1", "hits")


@query("path_default_of_nothing", "SELECT 'none' AS c0, 0::BIGINT AS hits")
def path_default_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.query(_status_tree(spark, sf_dir), "+[none]no such priority:+hits").plain()


@query("path_null_ok", "SELECT o_orderpriority AS c0, CASE WHEN count(*) > 5 * (SELECT count(*) FROM orders) // 25 THEN count(*) END AS hits FROM orders GROUP BY 1")
def path_null_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ~ a node that a bound refuses stays, without the value."""
    least = 5 * table(spark, sf_dir, "orders").count() // 25
    return trees.query(_status_tree(spark, sf_dir), f"~+:+hits>{least}").plain()


@query("path_limit_before_name", "SELECT p AS c0, hits FROM (SELECT o_orderpriority AS p, count(*) AS hits, row_number() OVER (ORDER BY o_orderpriority) AS r FROM orders GROUP BY 1) WHERE r BETWEEN 2 AND 3")
def path_limit_before_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.query(_status_tree(spark, sf_dir), "(1-2)+:+hits").plain()


@query("path_children_of_inner", "WITH n AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS hits FROM orders GROUP BY ALL) SELECT p AS c0, s AS c1, first_value(s) OVER (PARTITION BY p ORDER BY hits DESC, s) AS best FROM n")
def path_children_of_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inner level keeps of its children, on the rows of a level below."""
    tree = trees.built(table(spark, sf_dir, "orders"), [{"field": "o_orderpriority", "data": {"top": {"type": "top", "size": 2}}}, {"field": "o_orderstatus"}])
    rows = trees.query(tree, "+$+top/+").plain()
    return rows.select("c0", F.col(rows.columns[2]).alias("c1"), F.col(rows.columns[1]).alias("best"))


bundles("bundle_limit_upper", "orders", ORDERS[:2], {"op": "field", "from": "o_custkey", "filter": {"op": "limit-upper", "limit": 2}}, "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2", order=BY_KEY)
bundles("bundle_key_sieve", "orders", ORDERS[:2], {"op": "field", "from": "o_custkey", "filter": {"op": "key-sieve2", "tiers": 2}}, "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 2", order=BY_KEY)


@query("encoded_html", "SELECT '<table border=1 cellpadding=1 cellspacing=0>' AS value UNION ALL SELECT concat('<tr><td>', r_regionkey, '</td><td>&lt;', r_name, '&gt;</td></tr>') FROM region UNION ALL SELECT '</table>'")
def encoded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("<"), "r_name", F.lit(">")).alias("r_name"))
    return encoded(df, "html", header=True)


@query("sink_field_folders", "SELECT o_orderstatus, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL")
def sink_field_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder for each state and year, read back."""
    to = f"{shared_dir(spark)}/folders-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    write(orders.repartition("o_orderstatus", "y"), {"type": "file", "path": to + "/{{o_orderstatus}}/{{y}}"})
    return spark.read.parquet(to).groupBy("o_orderstatus", "y").agg(F.count("*").alias("n"))
