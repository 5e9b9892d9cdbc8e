"""The operators of treeline.llm against brute force, on awkward rows."""

import hashlib
import html as html_module
import json
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeline.llm import chat, decontam, graph, html, licenses, mixing, quality, simhash, spans, suffix, topk

RNG = random.Random(7)
WORDS = [("".join(RNG.choice("aeioubcdfglmnrstü") for _ in range(RNG.randint(2, 9)))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    out = []
    while n > 0:
        k = min(n, r.randint(4, 11))
        out.append(" ".join(r.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


PASSAGE = prose(70, "passage")
LONG = prose(9000, "long")


def rows():
    texts = [prose(60, k) for k in range(20)]
    texts += [texts[3], texts[3], texts[4] + " More here.", prose(40, 90) + " " + PASSAGE + " " + prose(30, 91), PASSAGE + " " + prose(20, 92), prose(10, 93) + " " + PASSAGE]
    texts += ["", None, " \n\t ", "a", "x" * 300, "x" * 200, "ab " * 200, LONG, LONG[:30000], "Ünïcödé " * 20, texts[0][:49], texts[0][:50], texts[0][1:51]]
    out = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[3], (7, "another text of the same id " + PASSAGE, "de", "src1", 3), (None, texts[5], None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("component_id", "fp", "h1", "n", "doc", "v", "z", "tokens", "x", "label", "features", "words", "run", "slot")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---------------------------------------------------------------------


def removed_by_brute_force(data, length=50):
    first = {}
    for d, t in data:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            g = raw[k : k + length]
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def test_suffix_dedup_equals_brute_force(docs):
    data = [(r[0], r[1]) for r in rows() if r[0] is not None]
    got = suffix.removals(docs).collect()
    named = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in got if r.doc_id is not None)
    assert named == sorted(removed_by_brute_force(data))
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id is None) == [(0, 0), (len(rows()[5][1].encode()), 0)]


def test_suffix_dedup_deals_hot_triggers_by_string(spark, monkeypatch):
    data = [(k, prose(9, k) + " " + PASSAGE[: 200 + k] + prose(9, -k)) for k in range(30)]
    monkeypatch.setattr(suffix, "HOT_PHRASES", 2)
    got = suffix.removals(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in got) == sorted(removed_by_brute_force(data))


def test_suffix_dedup_of_triggers_that_are_hot_in_a_chunk(spark, monkeypatch):
    """Chunks settle what they can; marks of hot triggers make other chunks deal theirs by string, too."""
    data = [(k, prose(9, k) + " " + PASSAGE[: 60 + k % 40] + prose(9, -k)) for k in range(60)]
    data += [(60 + k, data[k % 7][1]) for k in range(30)] + [(200 + k, prose(5, k) + PASSAGE) for k in range(3)]
    for chunk, most in ((600, 1), (2000, 2), (12_000_000, 3)):
        monkeypatch.setattr(suffix, "_CHUNK", chunk)
        monkeypatch.setattr(suffix, "CHUNK_PHRASES", most)
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
        got = suffix.removals(df).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in got) == sorted(removed_by_brute_force(data))


def test_a_chunk_sends_equal_phrases_once():
    trigger, phrase = np.array([5, 5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 3, 1], np.uint64)
    repeat, hot, mark = suffix._settled(trigger, phrase, 2)
    assert repeat.tolist() == [False, False, True, False, False]
    assert hot.tolist() == [True] * 4 + [False] and mark.tolist() == [True, False, False, False, False]
    assert not suffix._settled(trigger, phrase, 3)[1].any()


def test_suffix_dedup_of_nothing(none):
    assert suffix.removals(none).collect() == []


def test_each_string_has_its_trigger():
    raw = LONG.encode()[:5000] + b"a" * 400 + b"ab" * 100
    _, _, first, last = suffix.parsed(raw, 50, 16)
    assert first[0] == 0 and last[-1] == len(raw) - 50 and (first[1:] == last[:-1] + 1).all()


def test_corpus_order_is_that_of_bytes():
    content = np.frombuffer(b"abcabcabxabc\x00\x00b\x00\xff\xc3\x00\x00", np.uint8)
    begin = np.arange(len(content) - 2)
    order, new = suffix.corpus_order(content, begin, 3)
    assert order.tolist() == sorted(begin.tolist(), key=lambda b: (content[b : b + 3].tobytes(), b))
    assert new.sum() == len({content[b : b + 3].tobytes() for b in begin})


# --- 2 ---------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    data = [(k, [float(v) for v in np.round(r.normal(size=6), 1)]) for k in range(120)]
    data += [(120, data[0][1]), (121, data[0][1]), (122, None), (123, [1.0, None] * 3), (124, [float("nan")] * 6), (125, [float("inf")] * 6), (None, data[1][1]), (150, [1.0, 2.0]), (151, [0.5, 1.0]), (200, []), (201, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("slot", F.lit(1)).withColumn("label", F.lit("x"))
    sound = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in data if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, a in (s for s in sound if s[0] % 50 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), k) for k, b in sound if k != q and len(a) == len(b))
        expected += [(q, n, k, -s) for n, (s, k) in enumerate(scored[:5], 1)]
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), tile_rows=16, query_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert topk.top_k(df.limit(0), df.filter("vec_id = 0")).collect() == []


def test_top_k_holds_no_copies_for_each_partition(spark):
    """10,000 queries, whose copies for 800 partitions are more than the heap, meet in few tasks."""
    cells = "transform(sequence(0, 63), j -> cast((id * (2 * j + 1)) % 31 - 15 as float) / 8) embedding"
    df = spark.range(500000).filter("id % 50 = 0 OR id < 25").selectExpr("id vec_id", cells)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 800)
        got = topk.top_k(df.filter("vec_id < 25"), df.filter("vec_id % 50 = 0"), query_rows=10000).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = (np.floor(256 * ((np.asarray(x)[:, None] * (2 * np.arange(64) + 1)) % 31 - 15) / 8).astype(np.int64) for x in (range(0, 500000, 50), range(25)))
    scores = a @ b.T
    scores[0, 0] = -(10**9)  # the query itself
    found = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    got = got.sort_values(["query_id", "rank"])
    assert got["query_id"].tolist() == np.repeat(np.arange(0, 500000, 50), 5).tolist()
    assert got["vec_id"].tolist() == found.ravel().tolist()
    assert got["score"].tolist() == np.take_along_axis(scores, found, axis=1).ravel().tolist()


def test_top_k_of_several_groups_and_magnitudes(spark, monkeypatch):
    """Groups of queries see all candidates each; tiles of 16-bit, double and Python integers give one order; ties and repeats cross tiles."""
    monkeypatch.setattr(topk, "GROUP_BYTES", 300)
    r = np.random.default_rng(5)
    base = r.integers(-3, 4, (90, 4)).astype(float)
    data = [(int(k), (base[k % 90] * 10.0 ** r.choice([0, 0, 0, 4, 9, 200])).tolist()) for k in r.permutation(400)]
    data += [(k, data[0][1]) for k in (400, 401, 402, 402, 403, 403, 403)] + [(450, [0.0] * 4), (500, [0.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    whole = [(k, [int(x) * 256 for x in v]) for k, v in data]
    expected = []
    for q, a in (s for s in whole if s[0] % 50 == 0):
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))), k) for k, b in whole if k != q)
        expected += [(q, n, k, -s) for n, (s, k) in enumerate(scored[:5], 1)]
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), tile_rows=64, query_rows=2, slots=3)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_top_k_of_huge_components(spark):
    """Finite components whose multiple overflows a double take part; scores stay within a long."""
    df = spark.createDataFrame([(0, [1e306, 1.0]), (1, [1e306, 0.0]), (2, [-1e306, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, (1 << 63) - 1), (3, 256 * 512), (2, -(1 << 63))]


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, a)[0, 0] == (1 << 63) - 1
    assert topk.products(np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0]]))[0, 0] == (1 << 60) + 3


# --- 3 ---------------------------------------------------------------------


def test_quality_separates_junk(spark):
    good = [(k, prose(80, k)) for k in range(200)]
    bad = [(200 + k, " ".join(w.upper() + "!!" for w in prose(60, k).split())) for k in range(60)]
    odd = [(900, None), (901, ""), (902, LONG), (None, "text"), (903, "\x00 \u2028")]
    df = spark.createDataFrame([*good, *bad, *odd], "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("x", F.lit(2))
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(5, None, 0), (None, 1, 1), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(df, labels).collect()
    assert len(got) == len(good) + len(bad) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 260]
    assert len(held) > 20 and sum(r.predicted == (r.doc_id < 200) for r in held) >= 0.97 * len(held)
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.scored(df, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.scored(df, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.scored(df.limit(0), labels).collect() == []


def test_quality_equals_plain_discriminant(spark):
    """Differences of log densities as numpy's determinant and inverse give them; scores keep their order."""
    texts = [(k, prose(40 + k % 30, k) if k % 3 else " ".join(w.upper() for w in prose(10 + k % 9, k).split())) for k in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    x = np.array([quality.statistics(t.encode()) for _, t in texts])
    y = np.array([int(k % 3 > 0) for k, _ in texts])
    model = quality.fitted(spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "x array<double>, label int"))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    covariances = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(np.mean(y == c) * covariances[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        share = 0.2 + 0.8 * 16 / (16 + (y == c).sum())
        cov = 0.95 * ((1 - share) * covariances[c] + share * pooled) + 0.05 * np.diag(np.diag(pooled) + 1)
        d = np.clip(z, -8, 8) - z[y == c].mean(axis=0)
        logs.append(np.log(np.mean(y == c)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.differences(x), logs[1] - logs[0], atol=1e-6)
    assert (np.diff(model.scores(x)[np.argsort(model.differences(x))]) >= 0).all() and model.slope < 1
    got = {r.doc_id: r.score for r in quality.scored(df, spark.createDataFrame([(k, int(c)) for (k, _), c in zip(texts, y, strict=True)], "doc_id long, quality int"), held_out=10**9).collect()}
    assert np.allclose([got[k] for k, _ in texts], model.scores(x), atol=1e-6)
    assert np.isfinite([quality.statistics(b""), quality.statistics(b" \n")]).all()


def test_quality_of_repeated_rows(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows()) and len({r.score for r in got if r.doc_id == 3}) == 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.accepted(none, labels).collect() == []


# --- 4 ---------------------------------------------------------------------


def test_mixing_fills_siblings_before_ancestors(spark):
    text = lambda n: " ".join(["w"] * n)
    data = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000), ("b", "de", "s4", 1000)]
    leaves = spark.createDataFrame(data, "domain string, lang string, source string, tokens long")
    got = {r.source: r.quota for r in mixing.budgets(leaves, {}, (1, 2), 1).collect()}
    # a and b get 752 or 753 each; s1 can give 10 only, and its sibling s2 takes the rest of a's share
    assert sum(got.values()) == 1505 and got["s1"] == 10 and got["s2"] in (742, 743) and {got["s3"], got["s4"]} <= {376, 377}
    assert all(q <= 2 * t for q, t in ((got[s], t) for _, _, s, t in data))
    docs = spark.createDataFrame([(k, text(k % 7), "en", f"s{k % 3}") for k in range(300)] + [(None, None, None, None), (5, text(5), "en", "s2"), (5, text(5), "en", "s2")], "doc_id long, text string, lang string, source string").withColumn("whole", F.lit("clash"))
    mix = mixing.mixed(docs, F.lit("d"), {"source": {"s0": 5}}, (3, 1), 4)
    rows = mix.collect()
    total = sum((k % 7) for k in range(300)) + 10
    assert 0.97 * 3 * total <= sum(r.tokens * r.epochs for r in rows) <= 3 * total and max(r.epochs for r in rows) <= 4
    assert mixing.mixed(docs.limit(0), F.lit("d")).collect() == []


# --- 5 ---------------------------------------------------------------------


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 14))] for _ in "ab")
        kept = [x for x, s in zip(a, html.shared_lines(a, b), strict=True) if s]
        it = iter(b)
        assert all(x in it for x in kept) and len(kept) == longest(a, b)


def test_lengths_serve_halving():
    a, b = list("abcbdab"), list("bdcaba")
    assert [longest(a, b[:j]) for j in range(len(b) + 1)] == html._lengths(a, b)


def test_html_extraction(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><li><a>Home</a></nav><div class="cookie-notice">We use cookies</div>{}<form>Mail <input></form><footer>&copy; us</footer></body></html>'
    article = "<article><h1>Head &amp; more</h1><p>First <b>bold<br>line</b>\n two<p>Second&nbsp;par<aside>See also</aside><div class=comments><p>Nice!</div></article>"
    plain = "<div>Template line</div><div>Own text {}</div><p>Template end</p>"
    data = [(1, "http://a.org/x/1?q=1", page.format(article)), (2, "http://a.org/x/2", page.format(article)), (3, "http://b.org/1", page.format(plain.format("one"))), (4, "https://B.org:80/2#f", page.format(plain.format("two")))]
    data += [(5, None, "<p>Alone"), (6, "http://c.org", None), (7, "http://c.org/", ""), (None, "::", "just text &lt;here&gt; <unclosed"), (8, "http://d.org/long", "<p>" + LONG + "</p>"), (1, "http://a.org/x/1?q=1", page.format(article))]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("run", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html.extracted(df).collect()))
    texts = {k: t for k, t, _ in got}
    expected = "Head & more\nFirst bold line two\nSecond par"
    assert len(got) == len(data) and texts[1] == texts[2] == expected
    assert texts[3] == "Own text one" and texts[4] == "Own text two"
    assert texts[5] == "Alone" and texts[6] == texts[7] == "" and texts[0].startswith("just text <here>") and texts[8] == LONG
    assert all(n == len(t) for _, t, n in got) and html_module.unescape("&amp;") == "&"
    assert html.extracted(df.limit(0)).collect() == []


def test_html_differencing_decides_without_an_article_element(spark):
    """Big plain templates, short articles, a copy among the neighbours, text beside an article element."""
    template = [f"Template line {k} of the site" for k in range(30)]
    page = lambda *own: "".join(f"<div>{x}</div>" for x in [*template[:20], *own, *template[20:]])
    data = [(k, f"http://a.org/n/{k}", page(f"Only line of page {k}")) for k in range(6)]
    data += [(10, "http://b.org/n/1", page("Copied text")), (11, "http://b.org/n/1b", page("Copied text")), (12, "http://b.org/n/2", page("Another text"))]
    data += [(20 + k, f"http://c.org/{k}", f"<h1>Headline {k}</h1><div>Same teaser</div><article><p>Body {k}</p></article><div>Same end</div>") for k in range(2)]
    data += [(None, "http://a.org/n/x", page("Nameless"))]
    got = {(r.page_id, r.text) for r in html.extracted(spark.createDataFrame(data, "page_id long, url string, html string")).collect() if r.page_id != 10}  # 10 has a copy for its only neighbour
    assert got == {*((k, f"Only line of page {k}") for k in range(6)), (11, "Copied text"), (12, "Another text"), *((20 + k, f"Headline {k}\nBody {k}") for k in range(2)), (None, "Nameless")}


# --- 6 ---------------------------------------------------------------------


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_equal_brute_force(docs):
    data = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    ids = sorted({d for d, _ in data if d is not None})
    by_id = {d: [f for e, f in data if e == d] for d in ids}
    component = {d: {d} for d in ids}
    for a in ids:
        for b in ids:
            if any((x ^ y).bit_count() <= 2 for x in by_id[a] for y in by_id[b]) and component[a] is not component[b]:
                component[a] |= component[b]
                for c in component[a]:
                    component[c] = component[a]
    got = simhash.near_duplicates(docs, shard_rows=4)
    named = sorted((r.doc_id, r.fingerprint) for r in got.collect() if r.doc_id is not None)
    assert named == sorted((d, f"{f:016x}") for d, f in data if d is not None)
    single = {d for d in ids if len(by_id[d]) == 1}
    assert all(r.component_id == min(component[r.doc_id]) for r in got.collect() if r.doc_id in single)


def test_bk_tree_finds_all_within_the_radius():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << k) for k in (3, 40)] + [base ^ np.uint64(9)]))
    found = {(int(values[n]), int(values[q])) for n, near in simhash.BKTree(values).within(values, 2) for q in near}
    assert found == {(int(a), int(b)) for a in values for b in values if (int(a) ^ int(b)).bit_count() <= 2}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 100), (70, 71), (71, 70)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges)[0].collect()}
    assert all(roots[k] == 1 for k in range(2, 61)) and roots[71] == 70 and 1 not in roots


def test_representatives_keep_one_each(docs, none):
    kept = simhash.representatives(docs)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns and 20 not in ids and 3 in ids
    assert simhash.near_duplicates(none).collect() == []


def test_representatives_go_by_similarity(spark, docs):
    """Edited copies (five-word Jaccard of 0.8 or more) go, texts less alike stay; neither small parts nor the way of frequent shards change anything."""

    def own(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    texts = []
    for k in range(12):
        words = prose(150, 700 + k).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 9):
            changed = list(words)
            for e in range(edits):
                changed[10 + e * 130 // edits] = f"edit{e}"
            texts.append(" ".join(changed))
    component = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = own(texts[a]), own(texts[b])
            if len(x & y) >= 0.8 * len(x | y):
                component = [component[b] if c == component[a] else c for c in component]
    least = {c: component.index(c) for c in component}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"shard_rows": 2}, {"shard_rows": 2, "hot_rows": 3}):
        assert {r.doc_id: r.component_id for r in simhash.similar(df, **options).collect()} == {k: least[c] for k, c in enumerate(component)}
    kept = {r.doc_id for r in simhash.representatives(df).collect()}
    assert kept == set(least.values()) and 12 <= len(kept) < len(texts) / 2
    assert {r.fingerprint for r in simhash.near_duplicates(df.limit(1)).collect()} == {f"{plain_fingerprint(texts[0]):016x}"}


# --- 7 ---------------------------------------------------------------------


def cut_by_hand(t):
    """Pieces of a text by a scan of its characters."""
    out, now = [], ""
    for k, c in enumerate(t):
        now += c
        ends = re.search(r"[.!?,;:][\"')\]]*$", now) and (k + 1 == len(t) or t[k + 1].isspace())
        short = re.search(r"(?:^|[\s.(])(?:[A-Za-z]|Mr|Mrs|Ms|Dr|Prof|St|vs|Nr|bzw|Sr|Sra|Mme)\.$", now)
        if c in "\n\u3002\uff01\uff1f" or (ends and not short):
            out.append(now)
            now = ""
    return [*out, now] if now else out


def spans_by_brute_force(data, least=1, words=20):
    """Every run of enough pieces and words is hashed, not the shortest ones alone."""
    occurrences, cut = {}, []
    for place, (d, t) in enumerate(data):
        pieces = cut_by_hand(t or "")
        own = [(k, p.split()) for k, p in enumerate(pieces) if re.search(r"[^ \t\n\r\v\f]", p)]
        cut.append((pieces, own))
        sums = np.cumsum([0, *(len(w) for _, w in own)])
        for i in range(len(own)):
            for e in range(i + least - 1, min(len(own), i + 40)):
                if sums[e + 1] - sums[i] >= words:
                    key = tuple(tuple(w) for _, w in own[i : e + 1])
                    occurrences.setdefault(hash(key), []).append((d, place, i, e))
    gone = [set() for _ in data]
    for places in occurrences.values():
        first = min(p[0] for p in places)
        for d, place, i, e in places:
            first_here = min(p[2] for p in places if p[1] == place)
            if d > first or i > first_here:
                gone[place] |= {k for k, _ in cut[place][1][i : e + 1]}
    return [("".join(p for k, p in enumerate(pieces) if k not in gone[n]), len(own), len(gone[n])) for n, (pieces, own) in enumerate(cut)]


def test_sentence_spans_equal_brute_force(docs, none):
    data = [((1 << 63) - 1 if r[0] is None else r[0], r[1]) for r in rows()]
    expected = sorted((None if d == (1 << 63) - 1 else d, *x) for (d, _), x in zip(data, spans_by_brute_force(data), strict=True) if d != (1 << 63) - 1)
    got = spans.deduplicated(docs, carry=("lang", "v")).collect()
    assert sorted((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got if r.doc_id is not None) == expected
    assert len(got) == len(data) and all(r.v == "clash" for r in got)
    later = next(r for r in got if r.doc_id == 25)
    assert PASSAGE[200:300] not in later.text and later.n_removed > 0
    assert spans.deduplicated(none).collect() == []


def test_sentence_spans_of_hot_spans(spark, monkeypatch):
    """Spans in most documents go by broadcast, the others by a shuffle: to the same result."""
    monkeypatch.setattr(spans, "HOT_SHARE", 8)
    monkeypatch.setattr(spans, "SAMPLE", 2)
    data = [(k, prose(30, k) + " " + PASSAGE + " " + prose(30, k // 2 + 900)) for k in range(24)]
    got = spans.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.text, r.n_sentences, r.n_removed) for r in got) == sorted(spans_by_brute_force(data))


def test_pieces():
    for t in ("New York City Mayor John Smith met Dr. Who. Then, at 3.5 km; \u201cno\u201d!\nz. B. x?) End", "a.b c.", "\u3053\u3002\u3053\uff01", "", "\n\n", "J. Smith (St. Paul) said: no"):
        assert [p.decode() for p in spans.pieces_of(t.encode())] == cut_by_hand(t)
    assert spans.pieces_of(b"New York City Mayor John Smith met Dr. Who. Then, at 3.5 km") == [b"New York City Mayor John Smith met Dr. Who.", b" Then,", b" at 3.5 km"]


# --- 8 ---------------------------------------------------------------------


def test_license_scan(spark):
    texts = [
        "Some prose here.\n\nReleased under the MIT License.\n \nMore prose.",
        prose(30, 1) + "\nThis work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "You need a license to drive a car on this road.",
        prose(100, 2).replace(".", "") + " Licensed under the Apache License, Version 2.0. " + prose(80, 3).replace(".", ""),
        prose(50, 4), "", None, LONG,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("features", F.lit(1)).withColumn("row", F.lit(1))
    got = licenses.scanned(df)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.paragraph, r.family) for r in got.collect())
    assert found == [(-1, 1, "MIT"), (0, 1, "MIT"), (0, 1, "MIT"), (1, 0, "GPL-3.0"), (2, 0, "CC-BY-NC"), (4, 0, "Apache-2.0")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scanned(df.limit(0)).collect() == []


def test_license_scan_of_names_wraps_and_neighbours(spark):
    """Short names, notices over several lines, several families in one paragraph, other languages."""
    gpl = next(t for t in licenses.TEMPLATES["GPL-3.0"] if t.startswith("This program"))
    wrapped = "\n".join(re.findall(r".{1,40}(?: |$)", gpl))
    texts = {
        0: ("Released under the GNU GPL, version 3.", {"GPL-3.0"}), 1: ("Available under CC BY-NC 4.0.", {"CC-BY-NC"}), 2: ("Alle Rechte vorbehalten.", {"Proprietary"}), 3: ("Die Lizenz steht in der Datei.", set()),
        4: (prose(90, 6).replace(".", "") + " Released under the GNU GPL, version 3 " + prose(90, 7).replace(".", ""), {"GPL-3.0"}), 5: ("This text is CC BY 4.0.", {"CC-BY"}), 6: ("Released under GPLv3.", {"GPL-3.0"}),
        7: ("// SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}), 8: ("# SPDX-License-Identifier: MIT", {"MIT"}), 9: (prose(20, 8) + "\n" + wrapped + "\n" + prose(20, 9), {"GPL-3.0"}),
        10: ("Released under the MIT License. " + prose(60, 10) + " Licensed under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}), 11: ("Licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        12: ("Licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    }
    got = licenses.scanned(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")).collect()
    assert {k: {r.family for r in got if r.doc_id == k} for k in texts} == {k: v for k, (_, v) in texts.items()}


def test_license_scan_keeps_rows_apart(spark):
    """Rows without a doc_id, or with the same one, have notices of their own."""
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    got = licenses.scanned(spark.createDataFrame([(None, mit), (None, cc), (1, mit), (1, cc)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.family) for r in got.collect()) == [(0, "CC-BY"), (0, "MIT"), (1, "CC-BY"), (1, "MIT")]


def test_license_gate_loses_nothing():
    """Who holds enough of a template has a word of the gate, whichever pieces are missing."""
    gate = set(licenses.gate_words(0.7))
    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        pieces = licenses.pieces_in(text)
        without = [p for p in pieces if not set(p.split()) & gate]
        assert len(without) < licenses.needed(len(pieces), 0.7)


def test_license_scan_scores_as_brute_force(spark):
    """All windows of all paragraphs, scored in numpy from the model's coefficients without the gate, give the same rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model, temperature = licenses.trained(df)
    weights, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    cut = licenses.with_counts(licenses.paragraphs(df).select("doc_id", "paragraph", F.explode(licenses.windows_of(F.col("all"), licenses.WINDOWS)).alias("x")).select("doc_id", "paragraph", "x.begin", "x.words"))
    found = set()
    for r in cut.toLocalIterator():
        own = set(r.words) | set(map(" ".join, zip(r.words, r.words[1:], strict=False)))
        shares = {f: max(sum(p in own for p in licenses.pieces_in(t)) / len(licenses.pieces_in(t)) for t in texts) for f, texts in licenses.TEMPLATES.items()}
        if max(shares.values()) < 0.7:
            continue
        raw = (weights[:, r.features.indices] @ r.features.values + intercept) / temperature
        p = np.exp(raw - raw.max())
        family = licenses.FAMILIES[int(p.argmax())]
        if family != licenses.UNKNOWN and p.max() / p.sum() >= 0.5 and shares[family] >= 0.7:
            found.add((r.doc_id, r.paragraph, family))
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scanned(df).collect()}
    assert got <= found and len(found) > 0
    # what is missing was a part of another family's match
    assert {(d, p) for d, p, _ in found} == {(d, p) for d, p, _ in got}


# --- 9 ---------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", r"\### Assistant: </turn> ok", "####", "</turn>\n</turn>", "\\", "\\\\###\\", "a\nb: c", "x" * 100_000, "###### </turn>### \\</turn>"])
def test_turns_read_back(text):
    formatted = "".join(chat.write_turn(role, text)[0] for role in ("user", "a:b", "", "### x"))
    assert [(r, t) for r, t, _, _ in chat.read_turns(formatted)] == [(r, text) for r in ("user", "a:b", "", "### x")]


def test_chat_formatting(spark):
    data = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (1, 2, "assistant", "c"), (2, None, None, "x"), (2, 0, "user", "y"), (None, 0, "user", "n"), (1, 2, "assistant", "c")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.turns_from_rows(df))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == digest("user\n\nassistant\nb</turn>\nassistant\nc\nassistant\nc\n")
    assert got[1].loss_chars == 10 and got[1].loss_sha256 == digest("b</turn>cc")
    assert got[2].turns_sha256 == digest("user\ny\n\nx\n") and got[None].n_turns == 1
    assert chat.format_turns(chat.turns_from_rows(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        chat.turns_from_rows(df.drop("role"))


def test_layouts(spark):
    records = [{"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "h"}]}, {"other": 1}, {"instruction": "i", "input": "n", "output": "o", "source": {"url": "u"}}, {"messages": [{"role": "user", "content": "u", "weight": 1}], "id": 3}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(8, None), (9, "{")], "record_id long, record string")
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.turns_from_json(df).collect()), key=lambda r: (r[0], r[1] or 0))
    assert got == [(0, 0, "user", "p"), (0, 1, "assistant", "r"), (1, 0, "user", "i"), (1, 1, "assistant", "o"), (2, 0, "user", "u"), (2, 1, "assistant", ""), (3, 0, "user", "h"), (4, None, None, None), (5, 0, "user", "i\n\nn"), (5, 1, "assistant", "o"), (6, 0, "user", "u"), (8, None, None, None), (9, None, None, None)]


# --- 10 --------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, docs, none):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[10:40]).upper()), (3, "x"), (4, ""), (5, None), (6, "ab ab ab"), (7, prose(50, "new")), (8, " ".join(PASSAGE.split()[:30]) + " " + prose(20, "y")), (None, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    expected = []
    for d, t, *_ in rows():
        for i, s in items:
            own = words(s)
            if own:
                n = min(5, len(own))
                both = len(grams(own, n) & grams(words(t), n))
                if both >= 0.8 * len(grams(own, n)):
                    expected.append((d, i, both, len(grams(own, n))))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for size in (20_000, 2):
        got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contained(docs, bench, block_items=size).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
    kept = decontam.clean(docs, bench, block_items=2)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - len({k for k, r in enumerate(rows()) if any(r[0] == e[0] for e in expected) and _holds(r[1], items, words, grams)})
    assert decontam.contained(none, bench).collect() == [] and decontam.contained(docs, bench.limit(0)).collect() == []


def test_items_are_partitioned_by_size():
    """One depth a partition; a document with too few shingles for a partition still meets the others."""
    texts = [prose(n, f"size{n}") for n in (6, 12, 13, 80)]
    sketches = decontam.Sketches(list(enumerate(texts)), 5, 0.8)
    assert [(n, least) for n, least, _, _ in sketches.partitions] == [(5, 2), (5, 7), (5, 61)]
    for k, t in enumerate(texts):
        assert [f[0] for f in sketches.verified(t.encode())] == [k]
        assert [f[0] for f in sketches.verified((prose(500, "around") + " " + t).encode())] == [k]
    assert sketches.verified(b"") == [] and decontam.Sketches([], 5, 0.8).verified(b"a b c d e") == []


def _holds(text, items, words, grams):
    for _, s in items:
        own = words(s)
        if own:
            n = min(5, len(own))
            if len(grams(own, n) & grams(words(text), n)) >= 0.8 * len(grams(own, n)):
                return True
    return False


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    base = docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    for _, stage in cp.STAGES[1:4]:
        out = stage(spark, base, "/root/testdata/sf0.001")
        assert out.columns == base.columns and out.schema.simpleString() == base.schema.simpleString()
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "sentence_spans", "decontamination", "mixing"]
    rows_out = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert rows_out and all(r.epochs > 0 for r in rows_out)
