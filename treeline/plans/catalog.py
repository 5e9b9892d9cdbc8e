"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.bundle_filters import apply
from treeline.functions.value_filters import Value, filtered
from treeline.operators.registry import run
from treeline.plans import tree as trees
from treeline.plans.rows import Rows
from treeline.sources.read import bundled, read
from treeline.sources.write import encoded
from treeline.streaming import builders

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ops(name: str, source: str, columns: list[str], pipeline: str, sql: str, order: tuple[str, ...] = (), names: list[str] | None = None) -> None:
    """A query of ops over some columns (SQL expressions) of a table."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).selectExpr(*columns)
        done = run(Rows.of(df, *order), pipeline)
        out = done.plain()
        return out.toDF(*names) if names else out

    query(name, sql)(go)


CENTS = "cast(round({0} * 100) as bigint)"
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus as status", "cast(round(o_totalprice * 100) as bigint) as cents", "o_orderpriority as priority"]
O = "(SELECT o_orderkey, o_custkey, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT AS cents, o_orderpriority AS priority FROM orders)"
BY_KEY = ("o_orderkey",)

# --- aggregation ---

ops("gather", "orders", ORDERS[2:], "gather=ksku", f"SELECT status, sum(cents)::BIGINT AS cents, priority, count(*) AS n FROM {O} GROUP BY status, priority", names=["status", "cents", "priority", "n"])
ops("gather_average", "orders", ["o_orderpriority as priority", "o_custkey as a"], "gather=ka", "SELECT o_orderpriority AS priority, (sum(o_custkey) // count(*))::BIGINT AS a FROM orders GROUP BY 1")
ops("gather_extremes", "orders", ["o_orderpriority as priority", "o_custkey as a", "o_orderkey as b"], "gather=kmM", "SELECT o_orderpriority AS priority, min(o_custkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1")
ops("gather_join", "nation", ["n_nationkey", "n_regionkey", "n_name"], "gather=ikj", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1", order=("n_nationkey",))
ops("gather_last", "orders", ORDERS[:4], "gather=ikil", f"SELECT o_custkey, arg_max(cents, o_orderkey) AS cents FROM {O} GROUP BY 1", order=BY_KEY)
ops("gather_difference", "orders", ORDERS[:4], "gather=ikid", f"SELECT o_custkey, (2 * arg_min(cents, o_orderkey) - sum(cents))::BIGINT AS cents FROM {O} GROUP BY 1", order=BY_KEY)
ops("gather_distinct", "orders", ["o_orderpriority as priority", "o_custkey as n"], "gather=kC", "SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
ops("top", "orders", ["o_custkey", "cast(round(o_totalprice * 100) as bigint) as cents"], "top=10kts", f"SELECT o_custkey, sum(cents)::BIGINT AS cents FROM {O} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
ops("merge_runs", "orders", ORDERS[:4], "merge=iiksu", f"""
WITH f AS (SELECT *, CASE WHEN status = lag(status) OVER (ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM {O}),
i AS (SELECT *, sum(new) OVER (ORDER BY o_orderkey) AS island FROM f)
SELECT status, sum(cents)::BIGINT AS cents, count(*) AS rows FROM i GROUP BY island, status""", order=BY_KEY)
ops("merge_chunks", "orders", ORDERS[:4], "merge=iiksu3", f"""
WITH f AS (SELECT *, CASE WHEN status = lag(status) OVER (ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM {O}),
i AS (SELECT *, sum(new) OVER (ORDER BY o_orderkey) AS island FROM f),
c AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY o_orderkey) - 1) // 3 AS chunk FROM i)
SELECT status, sum(cents)::BIGINT AS cents, count(*) AS rows FROM c GROUP BY island, chunk, status""", order=BY_KEY)
ops("groupby_limit", "orders", ORDERS, "groupby=1:limit=2", f"SELECT * FROM {O} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2", order=BY_KEY)
ops("groupby_sort_limit", "orders", ORDERS, "sort=cents:l:d;groupby=o_custkey:limit=1", f"SELECT * FROM {O} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, o_orderkey) = 1", order=BY_KEY)
ops("fold", "orders", ORDERS[:4], "sort=1,0:l;fold=1:2:F,O,P:3", f"SELECT o_custkey, arg_max(cents, o_orderkey) FILTER (status = 'F') AS F_cents, arg_max(cents, o_orderkey) FILTER (status = 'O') AS O_cents, arg_max(cents, o_orderkey) FILTER (status = 'P') AS P_cents FROM {O} GROUP BY 1", order=BY_KEY)
ops("pivot", "orders", ORDERS[2:], "pivot=priority,status,cents,sum", f"SELECT priority, sum(cents) FILTER (status = 'F')::BIGINT AS F, sum(cents) FILTER (status = 'O')::BIGINT AS O, sum(cents) FILTER (status = 'P')::BIGINT AS P FROM {O} GROUP BY 1")
ops("pivot_totals", "orders", ORDERS[2:], "pivot=priority,status,cents,sum,sum,sum", f"""
WITH p AS (SELECT priority, coalesce(sum(cents) FILTER (status = 'F'), 0)::BIGINT AS F, coalesce(sum(cents) FILTER (status = 'O'), 0)::BIGINT AS O, coalesce(sum(cents) FILTER (status = 'P'), 0)::BIGINT AS P FROM {O} GROUP BY 1)
SELECT priority, F, O, P, F + O + P AS __sum__ FROM p UNION ALL SELECT '__sum__', sum(F)::BIGINT, sum(O)::BIGINT, sum(P)::BIGINT, sum(F + O + P)::BIGINT FROM p""")
ops("depivot", "nation", ["n_name", "n_nationkey", "n_regionkey"], "depivot=names:row,column,value", "SELECT n_name AS row, 'n_nationkey' AS column, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey::VARCHAR FROM nation", order=("n_nationkey",))
ops("transpose", "region", ["r_regionkey", "r_name"], "trans", "SELECT " + ", ".join(f"max(r_regionkey::VARCHAR) FILTER (r_regionkey = {k}) AS c{k}" for k in range(5)) + " FROM region UNION ALL SELECT " + ", ".join(f"max(r_name) FILTER (r_regionkey = {k})" for k in range(5)) + " FROM region", order=("r_regionkey",))
ops("frequency_table", "lineitem", ["l_returnflag as mode", "cast(l_quantity as bigint) as quantity", "1 as n"], "gather=kks;sort=0,1:s,l;ftable=0:1,2:0.25,0.5,total", """
WITH g AS (SELECT l_returnflag AS mode, l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY mode ORDER BY q) AS until, sum(n) OVER (PARTITION BY mode) AS t FROM g)
SELECT mode, min(q) FILTER (until >= round(t * 0.25)) AS "p0.25", min(q) FILTER (until >= round(t * 0.5)) AS "p0.5", max(t)::BIGINT AS total FROM c GROUP BY mode""")
ops("histogram", "orders", ["cast(o_totalprice as bigint) as v"], "histo=0", "SELECT pow(10, floor(log10(trunc(o_totalprice)) + 1e-12))::BIGINT AS bucket, count(*) AS count FROM orders WHERE trunc(o_totalprice) >= 1 GROUP BY 1")
ops("histogram_of_bounds", "lineitem", ["cast(l_quantity as bigint) as q"], "histo2=0,10,20,100", """
WITH b AS (SELECT unnest([-2147483648, 10, 20, 100]::BIGINT[]) AS bucket), v AS (SELECT trunc(l_quantity)::BIGINT AS q FROM lineitem),
c AS (SELECT CASE WHEN q >= 100 THEN 100 WHEN q >= 20 THEN 20 WHEN q >= 10 THEN 10 ELSE -2147483648 END::BIGINT AS bucket, count(*) AS n FROM v GROUP BY 1)
SELECT bucket, coalesce(n, 0)::BIGINT AS count FROM b LEFT JOIN c USING (bucket)""")
ops("distribution", "orders", ["o_custkey as v"], "distribution=0", """
WITH s AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey) AS r FROM orders), n AS (SELECT count(*) AS n FROM orders),
q AS (SELECT unnest([0.5, 0.75, 0.95, 0.98, 0.99, 0.999]::DOUBLE[]) AS quantile), p AS (SELECT quantile, n, greatest(least(quantile * (n + 1), n::DOUBLE), 1.0) AS place FROM q, n),
l AS (SELECT quantile, floor(place)::BIGINT AS low, place - floor(place) AS part, least(floor(place)::BIGINT + 1, n) AS high FROM p)
SELECT quantile, a.v::DOUBLE + part * (b.v::DOUBLE - a.v::DOUBLE) AS value FROM l JOIN s a ON a.r = low JOIN s b ON b.r = high""")
ops("percent_rank", "orders", ["o_orderkey", "o_custkey"], "percentrank=1:rank", "SELECT o_orderkey, o_custkey, rank() OVER (ORDER BY o_custkey)::DOUBLE / count(*) OVER () AS rank FROM orders")
ops("median_row", "orders", ORDERS[:2], "median", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) = count(*) OVER () // 2 + 1", order=BY_KEY)
ops("disorder", "orders", ORDERS[2:], "disorder=priority:status;num=c1,n1000000,*,n0.5,+,toi,v1,set,c2,n1000000,*,n0.5,+,toi,v2,set", f"""
WITH g AS (SELECT priority, status, count(*) AS n FROM {O} GROUP BY ALL), p AS (SELECT priority, n / sum(n) OVER (PARTITION BY priority) AS p FROM g)
SELECT priority, floor(-sum(p * log10(p)) * 1000000 + 0.5)::BIGINT AS entropy, floor((1 - sum(p * p)) * 1000000 + 0.5)::BIGINT AS gini FROM p GROUP BY 1""")
ops("remove_singletons", "orders", ORDERS[:3], "sort=1,0:l;rmsing=1:2", "SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders QUALIFY min(o_orderstatus) OVER (PARTITION BY o_custkey) <> max(o_orderstatus) OVER (PARTITION BY o_custkey)")

# --- rows ---

ops("order_columns", "orders", ORDERS, "order=4,0", "SELECT o_orderpriority AS priority, o_orderkey FROM orders")
ops("order_map", "orders", ["o_orderkey", "o_orderstatus as status", "o_orderpriority as priority"], "ordermap=1,F,2,1", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
ops("map_values", "orders", ORDERS[:3], 'map=status::{"F":"final","O":"open"}', "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
ops("map_patterns", "orders", ["o_orderkey", "o_orderpriority as priority"], 'rmap=priority::{"[12]-.*":"high",".*LOW":"low"}', "SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '.*LOW') THEN 'low' WHEN regexp_full_match(o_orderpriority, '[12]-.*') THEN 'high' ELSE o_orderpriority END AS priority FROM orders")
ops("compare", "orders", ORDERS, "compare=cents:gteq:30000000", f"SELECT * FROM {O} WHERE cents >= 30000000")
ops("contains", "orders", ORDERS, "contains=priority:HIGH,LOW", f"SELECT * FROM {O} WHERE contains(priority, 'HIGH') OR contains(priority, 'LOW')")
ops("calculate", "lineitem", ["l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as q"], "num=c2,n3,*,n7,-,v3,set,c2,n4,/,out,c2,n0,/,out,c2,n10,%,out", "SELECT l_orderkey, l_linenumber, q, q * 3 - 7 AS c3, q // 4 AS c4, 0::BIGINT AS c5, q % 10 AS c6 FROM (SELECT l_orderkey, l_linenumber, trunc(l_quantity)::BIGINT AS q FROM lineitem)")
ops("calculate_tests", "lineitem", ["l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as q"], "num=c2,n20,gteq,c2,n30,lt,c2,n25,minif,v2,set", "SELECT l_orderkey, l_linenumber, greatest(q, 25) AS q FROM (SELECT l_orderkey, l_linenumber, trunc(l_quantity)::BIGINT AS q FROM lineitem) WHERE q >= 20 AND q < 30")
ops("strings", "orders", ["o_orderkey", "o_orderpriority as priority"], "str=c1,v-,v1,/,v2,=,c1,v0,v1,:,v3,=,c1,v5-LOW,neq", "SELECT o_orderkey, o_orderpriority AS priority, split_part(o_orderpriority, '-', 2) AS c2, left(o_orderpriority, 1) AS c3 FROM orders WHERE o_orderpriority <> '5-LOW'")
ops("date_format", "orders", ["o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') as day"], "datef=1:yyyy-MM-dd:yyMMdd:ymd", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%y%m%d') AS ymd FROM orders")
ops("date_week", "orders", ["o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') as day"], "datef=1:yyyy-MM-dd:xxxxww:week", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%G%V') AS week FROM orders")
ops("fill", "orders", ["o_orderkey", "nullif(o_orderstatus, 'F') as status"], "fill=sx", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'x') AS status FROM orders")
ops("pad", "nation", ["n_nationkey", "n_name"], "pad=z:4", "SELECT n_nationkey, n_name, 'z' AS c2, 'z' AS c3 FROM nation")
ops("title", "nation", ["n_nationkey", "n_name"], "title=key,name", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation UNION ALL SELECT 'key', 'name'", order=("n_nationkey",))

# --- rolling and order ---

for _how in ("sum", "min", "max"):
    ops(f"running_{_how}", "orders", ORDERS[:4], f"{_how}=3", f"SELECT *, {_how}(cents) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS {_how}_cents FROM (SELECT o_orderkey, o_custkey, status, cents FROM {O})", order=BY_KEY)
    ops(f"running_{_how}_by_key", "orders", ORDERS[:4], f"sort=1,0:l;{_how}=3:1", f"SELECT *, {_how}(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS {_how}_cents FROM (SELECT o_orderkey, o_custkey, status, cents FROM {O})")
ops("running_average", "orders", ORDERS[:2], "avg=1", "SELECT o_orderkey, o_custkey, (sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) // row_number() OVER (ORDER BY o_orderkey))::BIGINT AS avg_o_custkey FROM orders", order=BY_KEY)
ops("delta", "orders", ORDERS[:2], "delta=1", "SELECT o_orderkey, o_custkey, o_custkey - lag(o_custkey, 1, 0) OVER (ORDER BY o_orderkey) AS delta_o_custkey FROM orders", order=BY_KEY)
ops("delta_by_key", "orders", ORDERS[:2], "sort=1,0:l;delta=0:1", "SELECT o_orderkey, o_custkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta_o_orderkey FROM orders")
ops("no_repeats", "orders", ORDERS[:3], "nodup=2", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (ORDER BY o_orderkey) THEN NULL ELSE o_orderstatus END AS status FROM orders", order=BY_KEY)
ops("sort_limit", "orders", ORDERS, "sort=3:l:d;limit=5:20", f"SELECT * FROM {O} ORDER BY cents DESC, o_orderkey LIMIT 20 OFFSET 5", order=BY_KEY)
ops("skip", "orders", ORDERS, "skip=3,2,5", f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM {O}) WHERE r >= 3 AND (r - 3) % 7 < 2", order=BY_KEY)
ops("row_range", "orders", ORDERS, "range=-30,-10", f"SELECT * EXCLUDE (r, n) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM {O}) WHERE r >= n - 30 AND r < n - 10", order=BY_KEY)
ops("reverse_limit", "orders", ORDERS, "reverse;limit=7", f"SELECT * FROM {O} ORDER BY o_orderkey DESC LIMIT 7", order=BY_KEY)

# --- value filters ---


def values(name: str, source: str, keys: list[str], given: dict[str, tuple[str, object]], sql: str) -> None:
    """A query of value filters: new column -> (SQL expression, filter)."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = df.select(*keys, *[F.expr(e).alias(c) for c, (e, _) in given.items()])
        return df.select(*keys, *[filtered(Value(F.col(c), df.schema[c].dataType), f).c.alias(c) for c, (_, f) in given.items()])

    query(name, sql)(go)


values(
    "filters_text", "customer", ["c_custkey"],
    {
        "lower": ("c_mktsegment", "case"), "cat": ("c_mktsegment", {"op": "cat", "pre": "<", "post": ">"}), "cut": ("c_mktsegment", {"op": "range", "start": 1, "end": -1}),
        "swap": ("c_mktsegment", {"op": "replace", "find": "I", "replace": "i"}), "pattern": ("c_mktsegment", {"op": "replace", "find": "[AEIOU]+", "replace": "-", "regex": True}),
        "back": ("c_mktsegment", "reverse"), "size": ("c_mktsegment", "length"), "padded": ("cast(c_custkey as string)", {"op": "pad", "left": "000000"}),
        "kept": ("c_mktsegment", {"op": "require", "contains": ["BUILD"]}), "refused": ("c_mktsegment", {"op": "exclude", "match": "[A-F].*"}),
        "globbed": ("c_mktsegment", {"op": "glob", "pattern": "*U*E"}), "not": ("c_mktsegment", {"op": "not", "filter": {"op": "contains", "value": "U"}}),
        "chained": ("c_mktsegment", [{"op": "range", "start": 0, "end": 3}, {"op": "case"}, {"op": "cat", "post": "."}]), "mapped": ("c_mktsegment", {"op": "map", "map": {"BUILDING": "b"}, "toNull": True}),
        "default": ("nullif(c_mktsegment, 'BUILDING')", {"op": "default", "value": "none"}),
    },
    """SELECT c_custkey, lower(m) AS lower, '<' || m || '>' AS cat, m[2:len(m) - 1] AS cut, replace(m, 'I', 'i') AS swap, regexp_replace(m, '[AEIOU]+', '-', 'g') AS pattern, reverse(m) AS back, len(m)::BIGINT AS size,
    lpad(c_custkey::VARCHAR, greatest(6, len(c_custkey::VARCHAR))::INTEGER, '0') AS padded, CASE WHEN contains(m, 'BUILD') THEN m END AS kept, CASE WHEN NOT regexp_full_match(m, '[A-F].*') THEN m END AS refused,
    CASE WHEN regexp_full_match(m, '.*U.*E') THEN m END AS globbed, CASE WHEN NOT contains(m, 'U') THEN m END AS not, lower(left(m, 3)) || '.' AS chained, CASE WHEN m = 'BUILDING' THEN 'b' END AS mapped, coalesce(nullif(m, 'BUILDING'), 'none') AS default
    FROM (SELECT c_custkey, c_mktsegment AS m FROM customer)""",
)
values(
    "filters_numbers", "orders", ["o_orderkey"],
    {"rest": ("o_custkey", {"op": "mod", "mod": 7}), "above": ("o_custkey", {"op": "inequality", "gteq": 50}), "hex": ("o_custkey", {"op": "intbase", "in": 10, "out": 16}), "from36": ("cast(o_custkey as string)", "baseconv"), "bits": ("o_custkey", "bit-split")},
    """SELECT o_orderkey, o_custkey % 7 AS rest, CASE WHEN o_custkey >= 50 THEN o_custkey END AS above, lower(to_hex(o_custkey)) AS hex,
    list_sum(list_transform(range(len(o_custkey::VARCHAR)), lambda i: (o_custkey::VARCHAR)[len(o_custkey::VARCHAR) - i]::BIGINT * pow(36, i)::BIGINT))::BIGINT AS from36,
    CASE WHEN o_custkey > 0 THEN list_filter(range(63), lambda k: (o_custkey >> k) & 1 = 1) END AS bits FROM orders""",
)
values(
    "filters_codes", "customer", ["c_custkey"],
    {"md5": ("c_mktsegment", "md5"), "base64": ("c_mktsegment", "base64"), "hex": ("c_mktsegment", "hexdump"), "sha": ("c_mktsegment", {"op": "hash", "type": 4})},
    "SELECT c_custkey, md5(m) AS md5, base64(m::BLOB) AS base64, trim(regexp_replace(lower(hex(m)), '(..)', '\\1 ', 'g')) AS hex, sha1(m) AS sha FROM (SELECT c_custkey, c_mktsegment AS m FROM customer)",
)
values("filter_murmur", "customer", ["c_custkey"], {"hash": ("c_mktsegment", {"op": "hash", "type": 1, "abs": True}), "java": ("c_mktsegment", {"op": "hash", "type": 0})}, "")
values(
    "filters_arrays", "orders", ["o_orderkey"],
    {
        "parts": ("o_orderpriority", {"op": "split", "split": "-"}), "first": ("split(o_orderpriority, '-')", {"op": "index", "index": 0}), "joined": ("split(o_orderpriority, '-')", {"op": "join", "join": "+"}),
        "sorted": ("split(o_orderpriority, '')", {"op": "sort"}), "each": ("split(o_orderpriority, '-')", {"op": "case"}), "long": ("split(o_orderpriority, '-')", {"op": "require", "match": ".{4,}"}),
        "sliced": ("split(o_orderpriority, '')", {"op": "slice", "from": 1, "to": 3}), "pieces": ("o_orderpriority", {"op": "split", "fixedLength": 3}), "cut": ("o_orderpriority", {"op": "string-slice", "sep": "-", "fromIndex": 1}),
        "found": ("o_orderpriority", {"op": "regex", "pattern": "([A-Z])([A-Z])"}),
    },
    """SELECT o_orderkey, string_split(p, '-') AS parts, split_part(p, '-', 1) AS first, replace(p, '-', '+') AS joined, list_sort(string_split(p, '')) AS sorted, list_transform(string_split(p, '-'), lambda x: lower(x)) AS each,
    CASE WHEN len(list_filter(string_split(p, '-'), lambda x: len(x) >= 4)) > 0 THEN list_filter(string_split(p, '-'), lambda x: len(x) >= 4) END AS long, string_split(p, '')[2:3] AS sliced,
    regexp_extract_all(p, '.{1,3}') AS pieces, split_part(p, '-', 2) AS cut, flatten(list_transform(regexp_extract_all(p, '[A-Z][A-Z]'), lambda x: [x[1], x[2]])) AS found FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders)""",
)
values(
    "filters_time", "orders", ["o_orderkey"],
    {"day": ("cast(unix_millis(cast(o_orderdate as timestamp)) as string)", {"op": "time-format", "formatOut": "yyMMdd"}), "next": ("date_format(o_orderdate, 'yyMMdd')", {"op": "time-range", "days": 1}), "days": ("concat(date_format(o_orderdate, 'yyMMdd'), '-', date_format(o_orderdate + interval 3 days, 'yyMMdd'))", "date-range-length")},
    "SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%y%m%d') AS next, 4::BIGINT AS days FROM orders",
)
SQL.pop("filter_murmur", None)

# --- bundle filters ---


def bundles(name: str, source: str, columns: list[str], spec, sql: str, order: tuple[str, ...] = ()) -> None:
    query(name, sql)(lambda spark, sf_dir: apply(Rows.of(table(spark, sf_dir, source).selectExpr(*columns), *order), spec).plain())


bundles("bundle_field", "orders", ORDERS, {"op": "field", "from": "priority", "filter": [{"op": "require", "contains": "-"}, {"op": "split", "split": "-"}, {"op": "index", "index": 1}], "to": "word"}, f"SELECT *, split_part(priority, '-', 2) AS word FROM {O}")
bundles("bundle_chain", "orders", ORDERS, [{"op": "field", "from": "status", "filter": {"op": "exclude", "value": ["P"]}}, {"op": "concat", "in": ["status", "priority"], "out": "both", "join": "/"}, {"op": "value", "to": "mark", "value": "x"}, {"op": "defaults", "default": {"mark": "y"}}, {"op": "template", "template": "{{status}}:{{o_custkey}}", "to": "text"}], f"SELECT *, status || '/' || priority AS both, 'x' AS mark, status || ':' || o_custkey AS text FROM {O} WHERE status <> 'P'")
bundles("bundle_condition", "orders", ORDERS, {"op": "condition", "if": {"op": "field", "from": "status", "filter": {"op": "require", "value": "F"}, "test": True}, "then": {"op": "field", "from": "priority", "filter": "case"}, "else": {"op": "field", "from": "priority", "filter": {"op": "range", "start": 0, "end": 1}}}, "SELECT o_orderkey, o_custkey, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT AS cents, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE left(o_orderpriority, 1) END AS priority FROM orders")
bundles("bundle_first", "orders", ["o_orderkey", "nullif(o_orderstatus, 'F') as a", "o_orderpriority as b"], {"op": "first", "in": ["a", "b"], "out": "c", "which": "w"}, "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, o_orderpriority AS b, CASE WHEN o_orderstatus <> 'F' THEN 'a' ELSE 'b' END AS w, coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS c FROM orders")
bundles("bundle_equals", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey % 5 as a", "l_suppkey % 5 as b"], {"op": "equals", "left": "a", "right": "b"}, "SELECT l_orderkey, l_linenumber, l_partkey % 5 AS a, l_suppkey % 5 AS b FROM lineitem WHERE l_partkey % 5 = l_suppkey % 5")
bundles("bundle_json", "events", ["event_id", "props"], {"op": "json", "query": "k", "field": "props", "to": "k"}, "SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
bundles("bundle_number", "orders", ORDERS[:4], {"op": "num", "define": "c3,n100,/,out"}, f"SELECT o_orderkey, o_custkey, status, cents, cents // 100 AS c4 FROM {O}")
bundles("bundle_append", "orders", ["o_orderkey", "split(o_orderpriority, '-') as p", "o_orderstatus as status"], {"op": "append", "to": "p", "values": ["z"], "from": "status"}, "SELECT o_orderkey, list_concat(string_split(o_orderpriority, '-'), ['z', o_orderstatus]) AS p, o_orderstatus AS status FROM orders")
bundles("bundle_limit", "orders", ORDERS, {"op": "limit", "limit": 11}, f"SELECT * FROM {O} ORDER BY o_orderkey LIMIT 11", order=BY_KEY)
bundles("bundle_recent", "events", ["event_id", "user_id", "unix_seconds(cast(ts as timestamp)) as at"], {"op": "recent2", "key": "user_id", "time": "at", "out": "n", "window": 3600}, "SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY \"at\" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS \"at\" FROM events)")
bundles("bundle_time_range", "orders", ["o_orderkey", "unix_millis(cast(o_orderdate as timestamp)) as at"], {"op": "time-range", "field": "at", "after": "960101", "before": "970101"}, "SELECT o_orderkey, epoch_ms(o_orderdate) AS at FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
bundles("bundle_url", "pages", ["page_id", "url"], {"op": "url", "field": "url", "setHost": "host", "setPath": "path"}, "SELECT page_id, url, lower(regexp_extract(url, '^[^:]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")

bundles("bundle_band", "orders", ORDERS[:2], {"op": "field", "from": "o_custkey", "filter": {"op": "band-pass", "minHits": 1, "maxHits": 3}}, "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 2 AND 3", order=BY_KEY)
bundles("bundle_count", "orders", ORDERS[:2], {"op": "field", "from": "o_custkey", "to": "n", "filter": {"op": "count", "start": 5, "increment": 2}}, "SELECT o_orderkey, o_custkey, 5 + 2 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS n FROM orders", order=BY_KEY)
bundles("bundle_serial", "orders", ORDERS[:2], {"op": "field", "from": "o_custkey", "to": "s", "filter": {"op": "serial", "base": 16, "prefix": "x", "round": 4}}, "SELECT o_orderkey, o_custkey, 'x' || lower(to_hex(r - r % 4)) AS s FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)", order=BY_KEY)

# --- trees ---


def order_tree(spark: SparkSession, sf_dir: str) -> trees.Tree:
    orders = table(spark, sf_dir, "orders").withColumns({"year": F.date_format("o_orderdate", "yyyy"), "cents": F.round(F.col("o_totalprice") * 100).cast("bigint"), "at": F.unix_millis(F.col("o_orderdate").cast("timestamp"))})
    data = {
        "cents": {"type": "sum", "key": "cents"}, "customers": {"type": "count", "key": "o_custkey", "ver": "exact"}, "time": {"type": "time", "key": "at"}, "top": {"type": "top", "size": 2},
        "states": {"type": "key.top", "key": "o_orderstatus", "size": 2}, "last": {"type": "copy", "key": "o_orderstatus", "order": "o_orderkey"}, "bits": {"type": "bits", "key": "o_custkey", "size": 4},
        "spread": {"type": "distribution", "key": "o_custkey"}, "seen": {"type": "bloom", "key": "o_orderstatus"}, "histo": {"type": "histo"},
    }
    return trees.built(orders, [{"const": "orders"}, {"field": "o_orderpriority", "data": data}, {"branch": [[{"field": "year"}, {"field": "o_orderstatus"}], [{"field": "o_orderstatus"}]]}])


def paths(name: str, path: str, pipeline: str, sql: str, names: list[str] | None = None) -> None:
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = trees.query(order_tree(spark, sf_dir), path, pipeline).plain()
        return out.toDF(*names) if names else out

    query(name, sql)(go)


T_SQL = """(SELECT *, strftime(o_orderdate, '%Y') AS y FROM orders)"""
N_SQL = f"""(SELECT ['orders'] AS path FROM {T_SQL} UNION ALL SELECT ['orders', o_orderpriority] FROM {T_SQL} UNION ALL SELECT ['orders', o_orderpriority, y] FROM {T_SQL}
UNION ALL SELECT ['orders', o_orderpriority, y, o_orderstatus] FROM {T_SQL} UNION ALL SELECT ['orders', o_orderpriority, o_orderstatus] FROM {T_SQL})"""


@query("tree_nodes", f"SELECT path, len(path)::INTEGER AS depth, path[-1] AS name, count(*) AS hits FROM {N_SQL} GROUP BY path")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tree(spark, sf_dir).nodes.select("path", "depth", "name", "hits")


@query("tree_file_paths", "SELECT list_slice(string_split(p, '/'), 1, n) AS path, count(*) AS hits FROM (SELECT replace(strftime(o_orderdate, '%Y-%m'), '-', '/') AS p FROM orders), (SELECT unnest([1, 2]) AS n) GROUP BY 1")
def tree_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy/MM").alias("p"))
    return trees.built(df, [{"file": "p"}]).nodes.select("path", "hits")


paths("path_collect", "orders/+:+hits,+nodes", "", f"WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path), c AS (SELECT path[:-2] AS path, count(*) AS nodes FROM n GROUP BY 1) SELECT path[2] AS c0, hits, coalesce(nodes, 0) AS nodes FROM n LEFT JOIN c USING (path) WHERE len(path) = 2")
paths("path_list", "orders/+1-URGENT,5-LOW/+F,O:+hits", "", f"SELECT o_orderpriority AS c0, o_orderstatus AS c1, count(*) AS hits FROM {T_SQL} WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O') GROUP BY ALL")
paths("path_range", "orders/*/+@1994,1996:+hits", "gather=ks", f"SELECT y AS c0, count(*)::BIGINT AS hits FROM {T_SQL} WHERE y >= '1994' AND y < '1996' GROUP BY 1")
paths("path_regex", "orders/+|[1-3]-.*/+!199.:+hits", "", f"WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path) SELECT path[2] AS c0, path[3] AS c1, hits FROM n WHERE len(path) = 3 AND regexp_full_match(path[2], '[1-3]-.*') AND NOT regexp_full_match(path[3], '199.')")
paths("path_prefix_limit", "orders/+{priority}/++199{year}(2):+hits", "", f"SELECT o_orderpriority AS priority, y AS year, count(*) AS hits FROM {T_SQL} WHERE y LIKE '199%' GROUP BY o_orderpriority, y QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY y) <= 2")
paths("path_bounds", "orders/+/+/+:+hits>40", "", f"SELECT o_orderpriority AS c0, y AS c1, o_orderstatus AS c2, count(*) AS hits FROM {T_SQL} GROUP BY ALL HAVING count(*) > 40")
paths("path_inner_property", "orders/+:+hits/+F:+hits", "", f"SELECT o_orderpriority AS c0, count(*) AS hits, 'F' AS c2, count(*) FILTER (o_orderstatus = 'F') AS hits_1 FROM {T_SQL} GROUP BY 1")
paths("path_parent", "orders/*/+F/+..", "", f"SELECT DISTINCT 'F' AS c0, o_orderpriority AS parent FROM {T_SQL} WHERE o_orderstatus = 'F'")
paths("path_reference", "orders/+/+@@orders/1-URGENT:+hits", "", f"WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path) SELECT path[2] AS c0, path[3] AS c1, hits FROM n WHERE len(path) = 3 AND path[3] IN (SELECT path[3] FROM n WHERE len(path) = 3 AND path[2] = '1-URGENT')")
paths("attachment_sum", "orders/+$+cents,+cents=avg,+cents=num", "", "SELECT o_orderpriority AS c0, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, (sum(round(o_totalprice * 100)::BIGINT) // count(*))::BIGINT AS cents_avg, count(*) AS cents_num FROM orders GROUP BY 1")
paths("attachment_count", "orders/+$+customers", "", "SELECT o_orderpriority AS c0, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
paths("attachment_time", "orders/+$+time=first,+time=last,+time=life", "", "SELECT o_orderpriority AS c0, epoch_ms(min(o_orderdate)) AS time_first, epoch_ms(max(o_orderdate)) AS time_last, epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate)) AS time_life FROM orders GROUP BY 1")
paths("attachment_copy_bits", "orders/+$+last=o_orderstatus,+bits=2,+seen=F,+seen=nothing", "", "SELECT o_orderpriority AS c0, arg_max(o_orderstatus, o_orderkey) AS last_o_orderstatus, sum((o_custkey >> 2) & 1)::BIGINT AS bits_2, max(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS seen_F, NULL::INTEGER AS seen_nothing FROM orders GROUP BY 1")
paths("attachment_key_top", "orders/+/+%states:+hits", "", "SELECT o_orderpriority AS c0, o_orderstatus AS c1, count(*) AS hits FROM orders GROUP BY o_orderpriority, o_orderstatus QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) <= 2")
paths("attachment_top", "orders/+/+%top:+hits", "", f"WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path) SELECT path[2] AS c0, path[3] AS c1, hits FROM n WHERE len(path) = 3 QUALIFY row_number() OVER (PARTITION BY path[2] ORDER BY hits DESC, path[3]) <= 2")
paths("attachment_histo", "orders/+/+%histo:+hits", "", f"WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path) SELECT path[2] AS c0, pow(10, floor(log10(hits) + 1e-9))::BIGINT::VARCHAR AS c1, count(*) AS hits FROM n WHERE len(path) = 3 GROUP BY ALL")
paths("path_ops", "orders/+/+/+:+hits", "gather=kiks;sort=2:l:d;limit=5", f"SELECT o_orderpriority AS c0, o_orderstatus AS c2, count(*)::BIGINT AS hits FROM {T_SQL} GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 5")


@query("path_union", """SELECT o_orderstatus AS c0, sum(n)::BIGINT AS hits FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1
UNION ALL SELECT o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) GROUP BY 1""")
def path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.query(order_tree(spark, sf_dir), ["orders/1-URGENT/+F,O,P:+hits", "orders/5-LOW/+F,O,P:+hits"], "gather=ks", "gather=ks").plain()


@query("tree_merged", f"SELECT path, 2 * count(*) AS hits FROM {N_SQL} WHERE len(path) < 4 AND path[3] IS NULL GROUP BY path")
def tree_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda: trees.built(table(spark, sf_dir, "orders"), [{"const": "orders"}, {"field": "o_orderpriority"}])
    return trees.merged(half(), half()).nodes.select("path", "hits")


@query("tree_pruned", f"SELECT path, count(*) AS hits FROM {N_SQL} WHERE len(path) < 3 OR path[3] >= '1996' GROUP BY path")
def tree_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.pruned(order_tree(spark, sf_dir), ["orders", "*"], F.col("name") >= "1996").nodes.select("path", "hits")


@query("tree_lookup", "SELECT c_custkey, n AS hits FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def tree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trees.built(table(spark, sf_dir, "orders"), [{"const": "orders"}, {"field": "o_custkey"}])
    return trees.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), t, [("const", "orders"), ("field", "c_custkey")], "hits")


@query("tree_alias", f"WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path) SELECT * FROM n UNION ALL SELECT list_concat(['urgent'], path[3:]), hits FROM n WHERE len(path) > 2 AND path[2] = '1-URGENT' UNION ALL SELECT ['urgent'], 0")
def tree_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.aliased(order_tree(spark, sf_dir), ["urgent"], ["orders", "1-URGENT"]).nodes.select("path", "hits")


@query("tree_limited", f"""
WITH n AS (SELECT path, count(*) AS hits FROM {N_SQL} GROUP BY path),
k AS (SELECT path FROM n WHERE len(path) = 3 QUALIFY row_number() OVER (PARTITION BY path[:2] ORDER BY hits DESC, path[3]) <= 3)
SELECT path, hits FROM n WHERE len(path) < 3 OR path[:3] IN (SELECT path FROM k)""")
def tree_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.limited(order_tree(spark, sf_dir), ["orders", "*"], 3).nodes.select("path", "hits")


# --- sources and builders ---


@query("source_aggregate", "SELECT n_name AS name, n_nationkey::BIGINT AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region UNION ALL SELECT unnest(['x', 'x', 'x']), 1")
def source_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, prefix: str) -> DataFrame:
        return read(spark, {"type": "files", "files": f"{sf_dir}/{name}.parquet"}).select(F.col(f"{prefix}_name").alias("name"), F.col(f"{prefix}_{name}key").cast("long").alias("key"))

    literal = read(spark, {"type": "const", "rows": [("x", 1)], "schema": "name string, key long", "repeat": 2})
    return part("nation", "n").unionByName(part("region", "r")).unionByName(literal)


@query("source_filtered", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def source_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"type": "filtered", "source": {"type": "parquet", "files": f"{sf_dir}/customer.parquet"}, "filter": {"op": "field", "from": "c_mktsegment", "filter": {"op": "require", "value": "BUILDING"}}}
    return read(spark, spec).select("c_custkey", "c_mktsegment")


@query("source_lines", "SELECT o_orderkey::VARCHAR AS key, left(o_orderpriority, 1) AS rank FROM orders WHERE o_orderpriority <> '5-LOW'")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    return bundled(lines, "regex", pattern=r"(?<key>\d+) (?<rank>\d)-.*", lineFilter={"op": "exclude", "contains": "5-LOW"})


@query("encoded_rows", """SELECT o_orderkey || '|' || o_orderpriority AS value FROM orders""")
def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "psv2")


@query("source_hashed")
def source_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, {"type": "hashed", "source": {"type": "parquet", "files": f"{sf_dir}/customer.parquet"}, "key": "c_custkey", "shardTotal": 4, "shards": [0, 2]}).select("c_custkey")


@query("builder_each", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
def builder_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.each(table(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("part")), "part")


@query("builder_row_splitter", "SELECT o_orderkey, unnest(list_concat(string_split(o_orderpriority, '-'), [NULL])) AS part FROM orders")
def builder_row_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.row_splitter(table(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("p")), "p", "part").select("o_orderkey", "part")


@query("builder_map_splitter", "SELECT o_orderkey, 's' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'p', o_orderpriority FROM orders")
def builder_map_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.map_splitter(table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("s"), "o_orderstatus", F.lit("p"), "o_orderpriority").alias("m")), "m")


@query("builder_repeat", "SELECT n_nationkey, n_regionkey FROM nation, range(10) r(k) WHERE k < n_regionkey")
def builder_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.repeat(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey")


@query("builder_join", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS o FROM orders GROUP BY 1 HAVING f IS NOT NULL AND o IS NOT NULL")
def builder_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS f", "CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS o")
    return builders.join(rows, "o_custkey", ["f", "o"])


@query("builder_sort_dedupe", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def builder_sort_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.sort_dedupe(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority, year and state as a tree; then a path query through ops."""
    return trees.query(order_tree(spark, sf_dir), "orders/+{priority}/+@1990,2000{year}:+hits", "sort=2:l:d").shown()
