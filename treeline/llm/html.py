"""Main text of web pages by nearest-URL page differencing (operator 5).

Pages are put in order of (host, URL path, page_id); each is paired with its nearest neighbour of the
same host, the one of the two beside it that shares the longer path prefix. The text lines (blocks) of
the two pages are aligned by their longest common subsequence, and lines that both share are template
and are deleted. A check of the markup follows, since copies of one article at two URLs share their
whole text, and templates may rotate within a host: blocks of menus, headers, footers, sidebars,
notices, adverts, forms and comments are deleted even if the neighbour lacks them; blocks of an
``article`` or ``main`` element are kept even if the neighbour has them, and where a page has such an
element, blocks outside of it are deleted.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import table, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|textarea|select|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr"}
#: Inline elements at which white space stands.
SPACED = {"br", "td", "th", "img"}
CONTAINERS = {"article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "li", "main", "menu", "nav", "ol", "section", "span", "table", "ul"}
MAIN = {"article", "main"}
BOILER = {"aside", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "button"}
#: Words of class, id or role that mark a block as no part of the article, anywhere or outside of an article only.
BOILER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}
OUTER_WORDS = {"alert", "bottom", "contentinfo", "copyright", "footer", "form", "head", "header", "login", "masthead", "menu", "search", "signup", "toolbar", "top", "topbar", "widget"}

PLAIN, IN_MAIN, IN_BOILER = 0, 1, 2


def blocks_of(html: str) -> tuple[list[str], list[int]]:
    """The text blocks of a page in page order, and each one's zone."""
    texts: list[str] = []
    zones: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = PLAIN

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                texts.append(text)
                zones.append(zone)
            parts.clear()

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in INLINE and tag != "span":
            if tag in SPACED:
                parts.append(" ")
            continue
        if m[2]:
            if tag != "span":
                close()
            if tag in CONTAINERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if zone != stack[k][1]:
                            close()
                        zone = stack[k][1]
                        del stack[k:]
                        break
            continue
        kind = _zone(tag, m[4] or "", zone)
        if tag != "span" or kind != zone:
            close()
        if tag in CONTAINERS:
            if not (m[4] or "").endswith("/"):
                stack.append((tag, zone))
                zone = kind
        elif kind == IN_BOILER and zone != IN_BOILER and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "tr", "button"):
            # an element whose end may be left out: it reaches to the next tag that opens or ends a block
            end = re.compile(rf"</{tag}\s*>|<(?:p|div|h[1-6]|ul|ol|section|article|/article|/div|/body)\b", re.I).search(html, at)
            stop = end.start() if end else len(html)
            text = " ".join(unescape(re.sub(r"<[^>]*>", " ", html[at:stop])).split())
            if text:
                texts.append(text)
                zones.append(IN_BOILER)
    if at < len(html):
        parts.append(unescape(html[at:]))
    close()
    return texts, zones


def _zone(tag: str, attributes: str, zone: int) -> int:
    if zone == IN_BOILER or tag in BOILER:
        return IN_BOILER
    if tag not in ("body", "html", "article", "main") and "=" in attributes:
        words = {w for found in _ATTRIBUTE.findall(attributes) for w in re.split(r"[^a-z]+", "".join(found).lower())}
        if words & BOILER_WORDS or zone != IN_MAIN and words & OUTER_WORDS:
            return IN_BOILER
    return IN_MAIN if tag in MAIN else zone


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` are on a longest common subsequence of ``a`` and ``b``.

    Equal beginnings and ends are matched first; the rest by rows of bits, one long integer a line, or,
    where those would take over 64 MB, by halves (Hirschberg).
    """
    shared = [False] * len(a)
    _align(a, b, 0, shared)
    return shared


def _align(a: list[str], b: list[str], at: int, shared: list[bool]) -> None:
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        shared[at + lo] = True
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        shared[at + hi_a] = True
    known = set(a[lo:hi_a])
    b = [x for x in b[lo:hi_b] if x in known]
    known = set(b)
    places = [k for k in range(lo, hi_a) if a[k] in known]
    if not places:
        return
    if len(places) * len(b) > 8 * 64_000_000:
        half = len(places) // 2
        left, right = [a[k] for k in places[:half]], [a[k] for k in places[half:]]
        ends = _lengths(left, b)
        begins = _lengths(right[::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: ends[j] + begins[len(b) - j])
        for part, other, where in ((left, b[:cut], places[:half]), (right, b[cut:], places[half:])):
            found = [False] * len(part)
            _align(part, other, 0, found)
            for k, yes in zip(where, found, strict=True):
                shared[at + k] = shared[at + k] or yes
        return
    rows = list(_rows([a[k] for k in places], b))
    j = len(b)
    for i in range(len(places) - 1, -1, -1):
        above = rows[i - 1] if i else (1 << len(b)) - 1
        # a zero bit marks a place where the length grows by one
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if j and above >> (j - 1) & 1:
            shared[at + places[i]] = True
            j -= 1


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[str], b: list[str]) -> list[int]:
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def main_text(texts: list[str], zones: list[int], neighbours: list[tuple[list[str], list[int]]]) -> str:
    """The page's text without template lines. ``neighbours``: nearest first; the first that isn't a copy is used.

    A copy has the same article: four fifths of the lines of the article or main element, or, on pages without one, all lines.
    Lines of that element stay; lines in neither it nor menus, adverts and the like stay if the neighbour lacks them.
    """
    drop = [False] * len(texts)
    for other, other_zones in neighbours:
        ours, theirs = ({t for t, z in zip(*page, strict=True) if z == IN_MAIN} for page in ((texts, zones), (other, other_zones)))
        share = 0.8
        if not ours or not theirs:
            ours, theirs, share = *({t for t, z in zip(*page, strict=True) if z != IN_BOILER} for page in ((texts, zones), (other, other_zones))), 1.0
        if len(ours & theirs) < share * max(1, min(len(ours), len(theirs))):
            drop = shared_lines(texts, other)
            break
    keep = [z == IN_MAIN or z == PLAIN and not d for z, d in zip(zones, drop, strict=True)]
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, without scheme, user, port, query and fragment; a null URL has none."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", (url or "").strip())
    if rest.startswith("//"):
        host, _, path = rest[2:].partition("/")
        host = host.split("?")[0].split("#")[0]
        return host.rpartition("@")[2].partition(":")[0].lower(), "/" + path.split("#")[0].split("?")[0]
    return "", rest.split("#")[0].split("?")[0]


def nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _key(host: str, path: str, page_id) -> tuple:
    return host, path, -(1 << 63) if pd.isna(page_id) else int(page_id)


def _bounds(pages: DataFrame, runs: int) -> list[tuple[tuple, tuple]]:
    """(last key before, first key) of each run but the first, of about ``runs`` runs of the ordered pages."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = [place_of(u) for u in f["url"]]
            yield pd.DataFrame({"host": [a[0] for a in at], "path": [a[1] for a in at], "page_id": [_key("", "", p)[2] for p in f["page_id"]]})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        for f in frames:
            yield f.assign(part=part, n=range(n, n + len(f)))
            n += len(f)

    kind = "host string, path string, page_id long"
    ordered = pages.select("page_id", "url").mapInPandas(keys, kind).sort("host", "path", "page_id").mapInPandas(counted, kind + ", part int, n long")
    ordered, _ = written(ordered, "url-order")
    sizes = {r["part"]: r["size"] for r in ordered.groupBy("part").agg((F.max("n") + 1).alias("size")).collect()}
    total, begins = 0, []
    for part in sorted(sizes):
        begins.append((part, total))
        total += sizes[part]
    step = max(2, -(-total // runs))
    start = F.lit(0)
    for part, begin in begins:
        start = F.when(F.col("part") == part, F.lit(begin)).otherwise(start)
    edges = ordered.withColumn("g", F.col("n") + start).filter((F.col("g") % step == 0) | (F.col("g") % step == step - 1)).sort("g").collect()
    by = {r["g"]: (r["host"], r["path"], r["page_id"]) for r in edges}
    return [(by[g - 1], by[g]) for g in sorted(by) if g and g % step == 0]


def extracted(pages: DataFrame, runs_per_partition: int = 8) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by
    one newline. Null and empty html gives an empty text. A null URL has the host "" and is paired like
    others; a null page_id sorts first. A page alone on its host, or whose two neighbours are copies of it, has only the check of the
    markup. Repeated rows are repeated in the result. Only page_id, url and html are read. An empty table
    gives an empty result. The driver holds a fixed number of run borders, never pages.
    """
    spark = pages.sparkSession
    runs = runs_per_partition * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bounds = spark.sparkContext.broadcast(_bounds(pages, runs))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, first = [b[0] for b in bounds.value], [b[1] for b in bounds.value]
        pack = zstandard.ZstdCompressor(level=3)
        for f in frames:
            out = []
            for page_id, url, html in zip(f["page_id"], f["url"], f["html"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                host, path = place_of(url)
                key = _key(host, path, page_id)
                run = bisect.bisect_right(first, key)
                blob = pack.compress(json.dumps(blocks_of(html or "")).encode())
                row = (host, path, page_id, url, blob)
                out.append((run, False, *row))
                if run < len(before) and key == before[run]:
                    out.append((run + 1, True, *row))
                if run and key == first[run - 1]:
                    out.append((run - 1, True, *row))
            yield pd.DataFrame(out, columns=["run", "context", "host", "path", "page_id", "url", "blob"]).astype({"page_id": "Int64"})

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # the page before, and the page to do

        def done(page: tuple, beside: list[tuple]) -> tuple:
            near = sorted((p for p in beside if p[:2] == page[:2]), key=lambda p: -nearness(p[2], page[2]))
            text = main_text(*page[5], [p[5] for p in near])
            return (page[3], page[4], text, len(text))

        for f in frames:
            out = []
            for run, context, host, path, page_id, url, blob in f.itertuples(index=False, name=None):
                page = (run, host, path, None if pd.isna(page_id) else int(page_id), url, json.loads(unpack.decompress(blob)), context)
                held.append(page)
                if len(held) > 1 and not held[-2][6]:
                    out.append(done(held[-2], [held[-1], *held[-3:-2]][::-1]))
                held = held[-2:]
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})
        if held and not held[-1][6]:
            yield pd.DataFrame([done(held[-1], held[-2:-1])], columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})

    parsed = pages.mapInPandas(parse, "run int, context boolean, host string, path string, page_id long, url string, blob binary")
    return parsed.repartition("run").sortWithinPartitions("run", "host", "path", "page_id", "url", "blob").mapInPandas(pair, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
