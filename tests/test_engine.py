"""Ops, filters, trees, sources and streams on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from treeline.functions.bundle_filters import apply
from treeline.functions.hashing import java_hash, murmur3_utf16
from treeline.functions.sketches import in_bloom
from treeline.functions.value_filters import Value, filtered
from treeline.operators.registry import run, split_ops
from treeline.plans import tree as trees
from treeline.plans.rows import Rows, islands, running
from treeline.sources.read import dated, read
from treeline.sources.write import write
from treeline.streaming import builders
from treeline.streaming.trees import GrowingTree


def table(spark, data, ops):
    width = max(len(r) for r in data)
    data = [(*r, *[None] * (width - len(r))) for r in data]
    names = [f"c{k}" for k in range(width)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "i int, " + ", ".join(f"{n} string" for n in names))
    rows = Rows(df.withColumnRenamed("i", "__k0").repartition(3), tuple(names), (("__k0", True),))
    return [tuple(r) for r in run(rows, ops).shown().collect()]


LETTERS = [("a", "1", "2", "3"), ("b", "1", "2", "3"), ("c", "1", "2", "3"), ("a", "1", "2", "3"), ("b", "1", "2", "3"), ("c", "1", "2", "3"), ("a", "1", "2", "3")]
RAGGED = [("a", "1", "2"), ("b", "1"), ("a", "1", "5", "2"), ("b", None, "4")]
STEPS = [(str(k), str(k // 3)) for k in range(8)]


@pytest.mark.parametrize(
    ("data", "ops", "expected"),
    [
        (LETTERS, "gather=ksssu;sort", [("a", 3, 6, 9, 3), ("b", 2, 4, 6, 2), ("c", 2, 4, 6, 2)]),
        (LETTERS, "gather=kiss;sort", [("a", 6, 9), ("b", 4, 6), ("c", 4, 6)]),
        (RAGGED, "gather=ksss;sort", [("a", 2, 7, 2), ("b", 1, 4, None)]),
        ([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")], "gather=kj;sort", [("a", "x,y"), ("b", "x,z")]),
        ([("a", "1"), ("a", "4"), ("b", "3")], "gather=ka;sort", [("a", 2), ("b", 3)]),
        ([(x[0], x[1:]) for x in "x1 a1 b2 c3 d9 a1 b2 c3 a1 y1".split()], "top=2,ktsu;sort", [("c", 6, 2), ("d", 9, 1)]),
        (STEPS, "avg=0:1", [(a, b, v) for (a, b), v in zip(STEPS, (0, 0, 1, 3, 3, 4, 6, 6), strict=True)]),
        (STEPS, "skip=1,2,1;order=0", [("1",), ("2",), ("4",), ("5",), ("7",)]),
        (STEPS, "range=1,-2;order=0", [("1",), ("2",), ("3",), ("4",), ("5",)]),
        (STEPS, "limit=2:3;order=0", [("2",), ("3",), ("4",)]),
        (STEPS, "sum=S0;range=-1", [("28", None)]),
        ([(str(k),) for k in range(5)], "distribution=0;limit=2", [(0.5, 2.0), (0.75, 3.5)]),
        ([("1", "5"), ("2", "4")], "num=c0,c1,maxif,v0,set", [(1, "5"), (2, "4")]),
        ([("1", "5"), ("2", "4")], "num=c0,c1,minif,v0,set", [(5, "5"), (4, "4")]),
        ([("8", "0"), ("x", "1")], "num=c0,c1,/,v0,set", [(0, "0")]),
        (STEPS, "groupby=1:limit=1;order=0", [("0",), ("3",), ("6",)]),
        (STEPS, "fold=1:0:0,1:0", [("0", "0", "1"), ("1", None, None), ("2", None, None)]),
        (STEPS[:2], "trans", [("0", "1"), ("0", "0")]),
        (STEPS[:2], "title=a,b", [("a", "b"), ("0", "0"), ("1", "0")]),
        (STEPS[:2], "pad=z:3", [("0", "0", "z"), ("1", "0", "z")]),
        ([("0",), ("5",), ("50",), ("-3",)], "histo=0", [(1, 2), (10, 1)]),
        ([("b",), (None,), ("a",)], "sort=0:s:a", [("a",), ("b",), (None,)]),
        ([("b",), (None,), ("a",)], "sort=0:s:d", [(None,), ("b",), ("a",)]),
        ([], "gather=k", None),
    ],
)
def test_ops(spark, data, ops, expected):
    if expected is None:
        empty = Rows.of(spark.createDataFrame([], "c0 string, c1 string"), "c0")
        for pipeline in ("gather=ks", "sum=1", "merge=ks", "median", "range=-1", "reverse", "distribution=1", "nodup", "percentrank=1:2"):
            assert run(empty, pipeline).shown().collect() == []
    else:
        assert table(spark, data, ops) == expected


def test_pipelines_are_cut_outside_of_braces():
    assert split_ops('filter={"op":"a;b"};sort=0;limit=1') == [("filter", '{"op":"a;b"}'), ("sort", "0"), ("limit", "1")]
    with pytest.raises(ValueError):
        run(None, "nothing=1")


def test_running_and_islands_cross_partitions(spark):
    df = spark.range(200).withColumn("k", (F.col("id") / 7).cast("int")).repartition(5)
    rows = Rows.of(df, "id")
    got = running(rows, "s", F.col("id"), "sum").df.orderBy("id").collect()
    assert [r.s for r in got] == [k * (k + 1) // 2 for k in range(200)]
    assert [r["__island"] for r in islands(rows, [F.col("k")]).df.orderBy("id").collect()] == [k // 7 + 1 for k in range(200)]


def test_hashes():
    assert abs(murmur3_utf16("128.0.0.1")) == 1407168586
    assert java_hash("hello") == 99162322 and java_hash("") == 0


@pytest.mark.parametrize(
    ("kind", "value", "spec", "expected"),
    [
        ("string", "AbC", "case", "abc"), ("string", "abc", {"op": "range", "start": -2}, "bc"), ("string", "", {"op": "default", "value": "x"}, "x"),
        ("array<string>", ["a", "bb"], {"op": "require", "match": "b+"}, ["bb"]), ("array<string>", ["a"], {"op": "require", "match": "b+"}, None), ("array<string>", ["b", "a"], {"op": "sort"}, ["a", "b"]),
        ("bigint", 12, "length", 12), ("bigint", -7, {"op": "mod", "mod": 5}, 2), ("string", "a=1,b=2", "create-map", {"a": "1", "b": "2"}), ("map<string,string>", {"a": "1", "b": "2"}, {"op": "map-value", "key": "b"}, "2"),
        ("map<string,string>", {"b": "2", "a": "1"}, {"op": "join", "sort": True}, "a=1,b=2"), ("string", "aGk=", {"op": "base64", "decode": True}, "hi"), ("string", "hi", "hexdump", "68 69"),
        ("string", "160115", {"op": "time-range", "days": 2, "range": True}, ["160115", "160116", "160117"]), ("string", "x", {"op": "python", "body": "lambda v: v * 2"}, "xx"), (None, None, None, None),
        ("string", "abc", {"op": "contains", "value": ["z", "b"], "returnMatch": True}, "b"), ("string", "a/b.txt", {"op": "glob", "pattern": "*/*.txt"}, "a/b.txt"), ("string", "5", {"op": "inequality", "lt": 5}, None),
    ],
)
def test_value_filters(spark, kind, value, spec, expected):
    if kind is None:
        with pytest.raises(ValueError):
            filtered(Value(F.lit("x")), "no such filter")
        return
    df = spark.createDataFrame([(value,)], f"v {kind}")
    assert df.select(filtered(Value(F.col("v"), df.schema["v"].dataType), spec).c.alias("v")).first()[0] == expected


def test_bundle_filters(spark):
    rows = Rows.of(spark.createDataFrame([("a", "1"), ("b", None), (None, "3")], "x string, y string"))
    assert {r.x for r in apply(rows, {"op": "field", "from": "y"}).plain().collect()} == {"a", None}
    assert {r.y for r in apply(rows, {"op": "not", "field": "x"}).plain().collect()} == {"3"}
    caught = apply(rows, {"op": "try", "try": {"op": "field", "from": "x"}, "catch": {"op": "value", "to": "x", "value": "?"}}).plain().collect()
    assert sorted(r.x for r in caught) == ["?", "a", "b"]
    cleared = apply(rows, [{"op": "clear", "field": "y"}]).plain().collect()
    assert [r.y for r in cleared] == [None, None]


def visits(spark):
    return spark.createDataFrame([("a", ["x", "y"], 1), ("a", ["x"], 2), ("b", [], 3), (None, ["x"], 4)], "host string, tags array<string>, n long")


SPEC = [{"const": "root"}, {"field": "host", "data": {"n": {"type": "sum", "key": "n"}}}, {"branch": [["tags"], [{"field": "n"}]]}]


def test_tree_counts_touches(spark):
    t = trees.built(visits(spark), SPEC)
    nodes = {tuple(r.path): (r.hits, r.nodes) for r in t.nodes.collect()}
    assert nodes == {("root",): (4, 2), ("root", "a"): (2, 4), ("root", "b"): (1, 1), ("root", "a", "x"): (2, 0), ("root", "a", "y"): (1, 0), ("root", "a", "1"): (1, 0), ("root", "a", "2"): (1, 0), ("root", "b", "3"): (1, 0)}
    got = [tuple(r) for r in trees.query(t, "root/+:+hits$+n").shown().collect()]
    assert got == [("a", 2, 3), ("b", 1, 3)]
    assert [tuple(r) for r in trees.query(t, "root/+/+(1)").shown().collect()] == [("a", "1"), ("b", "3")]
    with pytest.raises(ValueError):
        trees.query(t, "root/+:+nothing")
    path = "root/+{host}(2):+hits>1/*$+n=avg"
    assert trees.encoded(trees.decoded(path)) == path and [x["collect"] for x in trees.decoded(path)] == [False, True, False]


def test_tree_grows_with_a_stream(spark, tmp_path):
    data, out = str(tmp_path / "in"), str(tmp_path / "tree")
    visits(spark).repartition(4).write.parquet(data)
    grown = GrowingTree(spark, out, SPEC)
    stream = spark.readStream.schema(visits(spark).schema).option("maxFilesPerTrigger", 1).parquet(data)
    grown.follow(stream, str(tmp_path / "marks")).awaitTermination()
    expected = {(tuple(r.path), r.hits, r.nodes, r["n.sum"]) for r in trees.built(visits(spark), SPEC).nodes.collect()}
    assert {(tuple(r.path), r.hits, r.nodes, r["n.sum"]) for r in grown.tree().nodes.collect()} == expected
    last = grown.versions()[-1][0]
    grown.add(visits(spark).limit(0), last)  # the same batch again counts once
    assert grown.versions()[-1][0] == last


def test_sources_and_sinks(spark, tmp_path):
    from datetime import datetime

    assert dated("/d/{Y}/{M}{D}", datetime(2020, 2, 28), datetime(2020, 3, 1)) == ["/d/2020/0228", "/d/2020/0229", "/d/2020/0301"]
    path = str(tmp_path / "x")
    write(spark.range(10).selectExpr("cast(id as string) id", "cast(id % 2 as string) k"), {"type": "file", "path": path, "format": "column"})
    back = read(spark, {"type": "files", "files": path, "format": "column", "options": {"columns": ["id", "k"]}})
    assert sorted((r.id, r.k) for r in back.collect()) == [(str(k), str(k % 2)) for k in range(10)]
    shards = [read(spark, {"type": "hashed", "source": {"type": "const", "rows": [(str(k),) for k in range(50)], "schema": "k string"}, "key": "k", "shardTotal": 3, "shards": [s]}).count() for s in range(3)]
    assert sum(shards) == 50 and min(shards) > 0
    pairs = read(spark, [{"type": "const", "rows": [("a=1&b=%20",)], "schema": "value string"}])
    from treeline.sources.read import bundled

    assert bundled(pairs, "query", ["a", "b", "c"]).first() == ("1", " ", None)
    assert bundled(pairs, "kv", ["a", "b", "c"]).first() == ("1", "%20", None)
    lines = spark.createDataFrame([("GET /x 200",), ("nonsense",), ("# GET /y 404",)], "value string")
    assert bundled(lines, "regex", pattern=r"(?<verb>[A-Z]+) (?<path>\S+) (?<code>\d+)", lineFilter={"op": "exclude", "find": "^#"}).collect() == [("GET", "/x", "200")]
    assert bundled(lines, "noop", ["line"]).columns == ["line"]
    from treeline.sources.write import encoded

    cells = spark.createDataFrame([("a,b", 'say "x"', None)], "x string, y string, z string")
    assert [r.value for r in encoded(cells, "csv2", header=True).collect()] == ["x,y,z", '"a,b","say ""x""",']
    assert encoded(cells, "tsv2").first().value == 'a,b\t"say ""x"""\t'


def test_builders(spark):
    df = visits(spark)
    assert builders.each(df, "tags").count() == 4 and builders.row_splitter(df, "tags", "t").count() == 8
    assert builders.repeat(df, 3).count() == 12 and builders.chain(df, [lambda d: d, lambda d: builders.repeat(d, 2)]).count() == 12


def test_catalog_has_sql_for_its_queries():
    from treeline.plans import catalog

    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.SQL) > 90


def test_entry_without_the_corpus_package():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "gather" in e.queries()


def test_series(spark):
    pairs = [tuple(x.split()) for x in "cat a 1|cat b 2|cat a 3|cat b 3|dog a 6|dog b 7|dog a 8|dog b 8|dog b 9|dog b 4|dog a 2|dog b 3|dog a 6|dog a 8|foo a 3|bar a 3".split("|")]
    assert table(spark, pairs, "diff=kad") == [("cat", "", 1), ("cat", "", 0), ("dog", "", 1), ("dog", "", 0), ("dog", "+", 9), ("dog", "+", 4), ("dog", "", 1), ("dog", "", 2), ("foo", "-", -3)]
    days = [("MONDAY", "10"), ("TUESDAY", "10"), ("WEDNESDAY", "10"), ("THURSDAY", "1000"), ("FRIDAY", "10"), ("SATURDAY", "10")]
    assert table(spark, days, "changepoints=0:1") == [("THURSDAY", "PEAK", 990)]
    steady = table(spark, [(str(k), str(10 + k % 4)) for k in range(24)], "holtwinters=0:1:0.2:0.2:0.2:4:1")
    assert len(steady) == 24 and all(abs(r[3]) < 15 for r in steady[12:])
    assert [tuple(r) for r in run(Rows.of(spark.createDataFrame([], "t string, v string"), "t"), "changepoints=0:1").shown().collect()] == []


def test_sketches(spark):
    from treeline.functions.sketches import count_min_count

    df = spark.createDataFrame([("a",)] * 5 + [("bcdefg",)] * 3 + [(None,)], "v string")
    cms = df.agg(F.count_min_sketch("v", F.lit(0.001), F.lit(0.99), F.lit(1)).alias("s"))
    assert cms.select(count_min_count(F.col("s"), "a"), count_min_count(F.col("s"), "bcdefg"), count_min_count(F.col("s"), "x"), count_min_count(F.col("s"), None)).first() == (5, 3, 0, 8)
    bloom = run(Rows.of(df), "seen=v").plain().first()[0]
    other = spark.createDataFrame([("a",), ("bcdefg",), ("x",), (None,)], "v string")
    passed = other.select(filtered(Value(F.col("v")), {"op": "seen", "bloom": bloom}).c.alias("v")).collect()
    assert [r.v for r in passed] == ["a", "bcdefg", None, None]


def test_exact_counts_apart_from_sketches(spark):
    """One sketch a node, not one for each of its values; what isn't asked for isn't computed."""
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("b", "z")], "k string, v string")
    data = {"n": {"type": "count", "key": "v", "ver": "exact"}, "hll": {"type": "count", "key": "v"}, "s": {"type": "count.min.sketch", "key": "k"}}
    t = trees.built(df, [{"field": "k", "data": data}, {"field": "v", "data": {"below": {"type": "count", "key": "k", "ver": "exact"}}}])
    assert [tuple(r) for r in trees.query(t, "+$+n,+hll,+s=total,+below").plain().collect()] == [("a", 2, 2, 3, 0), ("b", 1, 1, 2, 0)]
    assert [tuple(r) for r in trees.query(t, "+/+$+below,+n").plain().collect()] == [("a", "x", 1, 0), ("a", "y", 1, 0), ("b", "z", 1, 0)]
    of = lambda df: [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(keys" in line]
    sketches = [line for line in of(t.nodes) if "sketch" in line]
    assert sketches and all("," not in re.search(r"keys=\[([^\]]*)\]", line)[1] for line in sketches)
    assert len(of(trees.query(t, "+:+hits").plain())) < len(of(trees.query(t, "+:+hits$+n").plain()))


def test_bloom_of_more_values_than_its_max(spark):
    """A node of more values than ``max`` gets a larger filter, so that the error stands; others keep theirs."""
    df = spark.range(60_000).select(F.when(F.col("id") < 59_000, "many").when(F.col("id") < 59_990, "few").otherwise("none").alias("k"), F.when(F.col("id") < 59_990, F.col("id").cast("string")).alias("v"))
    t = trees.built(df, [{"field": "k", "data": {"b": {"type": "bloom", "key": "v", "max": 10_000, "error": 0.01}}}])
    asked = df.select("v").filter("v IS NOT NULL").unionAll(spark.range(60_000).select((-F.col("id") - 1).cast("string").alias("v")))
    nodes = t.nodes.select("name", F.col("`b.bits`").alias("bits"))
    passed = asked.crossJoin(nodes).filter(in_bloom(F.col("bits"), F.col("v"), 4)).withColumn("own", ~F.startswith("v", F.lit("-")))
    found = {(r.name, r.own): r.n for r in passed.groupBy("name", "own").agg(F.count("*").alias("n")).collect()}
    assert found["many", True] >= 59_000 and 0 < found["many", False] < 0.02 * 60_000
    assert 990 <= found["few", True] < 1000 and ("few", False) not in found and ("none", True) not in found
    assert [tuple(r) for r in nodes.select("name", F.size("bits")).sort("name").collect()] == [("few", 4), ("many", 20), ("none", 4)]
    assert [tuple(r)[1] < 51 for r in trees.query(t, "+$+b=sat").plain().collect()] == [True] * 3
    assert [tuple(r) for r in trees.query(t, "+$+b=7~8,+b=7~-7").plain().collect()] == [("few", None, None), ("many", 1, None), ("none", None, None)]
    known = run(Rows.of(df.select("v")), "seen=0,4,10000").plain().first()[0]
    assert len(known) == 5 * 4 * 4096
    kept = asked.select(filtered(Value(F.col("v")), {"op": "seen", "bloom": known}).c.alias("v")).filter("v IS NOT NULL")
    assert kept.filter("v NOT LIKE '-%'").count() == 59_990 and kept.filter("v LIKE '-%'").count() < 0.02 * 60_000
    nothing = run(Rows.of(df.filter("v IS NULL").select("v")), "seen=v").plain().collect()
    assert [bytes(r[0]) for r in nothing] == [bytes(4 * 4096)]


def test_reservoir(spark):
    counts = {1: 10, 2: 12, 3: 11, 4: 9, 5: 30}
    df = spark.createDataFrame([("h", e) for e, n in counts.items() for _ in range(n)], "host string, epoch long")
    t = trees.built(df, [{"field": "host", "data": {"r": {"type": "reservoir", "epochField": "epoch", "size": 5}}}])
    assert [tuple(r) for r in trees.query(t, "+/+%r:+hits").shown().collect()] == [("h", str(e), counts[e]) for e in (5, 4, 3, 2, 1)]
    got = trees.query(t, "+$+r=epoch||5~obs||4~mode||sigma~sigma||2").shown().first()[1]
    spread = (sum((x - 10.5) ** 2 for x in (10, 12, 11, 9)) / 4) ** 0.5
    assert got[:4] == [30 - (10.5 + 2 * spread), 30, 10.5, spread]
    assert trees.query(t, "+$+r=epoch||4~obs||3~mode||sigma~sigma||2").shown().first()[1] is None
    assert trees.query(t, "+$+r=epoch||5~obs||4~mode||modelfit~percentile||95").shown().first()[1][5] > 99


def test_date_macros():
    from datetime import datetime, timezone

    from treeline.functions.dates import expanded

    now = datetime(2024, 3, 1, 1, 30, tzinfo=timezone.utc)
    assert expanded("a/{{now}}/{{now-1}}/b", now) == "a/240301/240229/b"
    assert expanded("{{now-2h}} {{now+1::yyyy-MM-dd}} {{now-2h::HH:America/New_York}}", now) == "24022923 2024-03-02 18"
    with pytest.raises(ValueError):
        expanded("{{now::EEE}}", now)


def test_levels_with_limit_null_and_default_before_the_name():
    level = trees.decoded("(2-5)~+[none|3]a,b{x}:+hits>2")[0]
    assert (level["limit"], level["null_ok"], level["default"], level["match"], level["label"]) == ((2, 5), True, ("none", 3), "a,b", "x")
    assert trees.decoded("+%[none]top:+hits")[0]["match"] == "%top" and trees.decoded("+*(3)")[0]["limit"] == (0, 3)


def test_default_of_virtual_nodes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "k string, v string")
    t = trees.built(df, [{"field": "k", "data": {"top": {"type": "top", "size": 1}}}, {"field": "v"}])
    got = trees.query(t, "+/+%[none|5]top:+hits").plain().collect()
    assert sorted(map(tuple, got)) == [("a", "x", 2), ("b", "none", 5)]
    with pytest.raises(ValueError):
        trees.query(t, "+[none]x/+")
