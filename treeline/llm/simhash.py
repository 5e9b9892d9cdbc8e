"""SimHash near-duplicates (operator 6): BK-trees over distinct fingerprints.

Copies share a fingerprint and collapse first. Two fingerprints within ``radius`` bits agree on at least
one of radius + 1 blocks of bits, so each shard is a set of fingerprints that share one block. A BK-tree
is built for each shard, its children keyed by their Hamming distance to the parent, and queries follow
only edges within the radius. A shard above ``shard_rows`` is split into a grid of pairs of sub-shards:
each sub-shard's tree is sent to the tasks that hold its queries, a bounded number of rows each.
A shard gives only a spanning forest of its links, which keeps components and their size in proportion.

``representatives`` takes near-duplicates by similarity (Jaccard of five-word shingles). There the
fingerprints lie many bits apart, so that blocks of bits would share nearly everything with everything;
shards are bands of MinHashes instead, and what a shard's BK-tree finds is verified by exact Jaccard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import mixed, removed, table, written
from treeline.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: For near-duplicates by similarity; at 0.8 fingerprints differ in some 10 of 64 bits.
SIMILAR_SHINGLE, LEAST, SIMILAR_RADIUS = 5, 0.8, 24
#: Tasks over which the rows of a frequent shard are dealt.
SALTS = 32


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the XXH64 of the text's word shingles."""
    return majority(shingles(text, n, seed))


def shingles(text: bytes, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each of the text's word shingles; a text of fewer words is one shingle, if it has any."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hash_of = xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([hash_of(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    begins = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        begins.append(at)
    return np.array([hash_of(joined[a : b - 1], seed) for a, b in zip(begins, begins[n:])], np.uint64)  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (a signed long) of every whole text; null texts are empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, fp long")


class BKTree:
    """A tree of distinct 64-bit values. Searches take many queries at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        plain = values.tolist()
        for k in range(1, len(plain)):
            at = 0
            while True:
                d = (plain[k] ^ plain[at]).bit_count()
                child = self.children[at].setdefault(d, k)
                if child == k:
                    break
                at = child

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, which queries) of each node that has queries within the radius."""
        if not len(self.values):
            return
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, which = stack.pop()
            d = np.bitwise_count(queries[which] ^ self.values[node]).astype(np.int16)
            near = which[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                rest = which[np.abs(d - edge) <= radius]
                if len(rest):
                    stack.append((child, rest))


def forest(tree_values: np.ndarray, query_values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (query, tree node) that join the same values as all links within the radius would."""
    label = np.arange(len(tree_values) + len(query_values))
    links = []
    for node, near in BKTree(tree_values).within(query_values, radius):
        members = near + len(tree_values)
        apart = members[label[members] != label[node]]
        if len(apart):
            merged, first = np.unique(label[apart], return_index=True)
            links += [(int(q) - len(tree_values), node) for q in apart[first]]
            label[np.isin(label, merged)] = label[node]
    return links


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that make up 64 bits."""
    n = radius + 1
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = 8192) -> DataFrame:
    """Edges (a, b) between ids of ``distinct`` (id, fp), enough to connect all within the radius."""
    keyed = distinct.select("id", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("bits")) for k, (s, w) in enumerate(blocks(radius))])).alias("x")).select("id", "fp", "x.block", "x.bits")
    counts = keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    split = F.ceil(F.col("n") / shard_rows).cast("int")
    dealt = keyed.join(counts, ["block", "bits"]).withColumn("parts", split).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = dealt.withColumn("other", other).select("block", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "fp")

    keys = ["block", "bits", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in _and_end(batches):
            own = held if batch is None else [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            if own is None:
                continue
            if batch is not None and held is not None:
                own = [np.concatenate(c) for c in zip(held, own, strict=True)]
            changes = np.zeros(max(0, len(own[0]) - 1), bool)
            for c in own[:4]:
                changes |= c[1:] != c[:-1]
            begins = np.concatenate([[0], np.flatnonzero(changes) + 1]) if len(own[0]) else np.empty(0, np.int64)
            ends = np.append(begins[1:], len(own[0]))
            if batch is not None and len(begins):  # the last shard may go on in the next batch
                held = [c[begins[-1] :].copy() for c in own]
                begins, ends = begins[:-1], ends[:-1]
            a, b = _linked(own, begins, ends, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt_out = cells.select(*keys, "part", "id", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt_out.mapInArrow(search, "a long, b long").filter("a <> b")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _linked(cells: list[np.ndarray], begins: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the shards that lie from ``begins`` to ``ends``. A tree of two nodes is one distance; those are taken together."""
    _, _, i, j, part, ids, fps = cells
    values, sizes = fps.view(np.uint64), ends - begins
    two = begins[sizes == 2]
    near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= radius]
    a, b = [ids[near + 1]], [ids[near]]
    for lo, hi in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        tree = asked = np.arange(lo, hi)
        if i[lo] != j[lo]:
            tree, asked = tree[part[lo:hi] == i[lo]], tree[part[lo:hi] == j[lo]]
        found = forest(values[tree], values[asked], radius)
        a.append(ids[asked[[q for q, _ in found]]] if found else ids[:0])
        b.append(ids[tree[[t for _, t in found]]] if found else ids[:0])
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, shard_rows: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``documents``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id that can be reached, the row's own included. Null and empty texts, and texts of white space,
    have the fingerprint 0 and are linked like any other. Rows with a null doc_id get a fingerprint and
    the component of their text's fingerprint, but lend it no id (null if no row of the fingerprint has
    one). Repeated rows are repeated in the result. Only doc_id and text are read.
    """
    marked, _ = written(fingerprints(documents, shingle, seed), "fingerprints")
    distinct, _ = written(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    named = distinct.filter("id IS NOT NULL")
    roots, _ = components(links(named, radius, shard_rows).groupBy("a", "b").agg(F.lit(1).alias("one")))
    known = distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return marked.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- by similarity ---------------------------------------------------------


def _digest(own: np.ndarray) -> tuple[int, int]:
    found = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
    return int(found[0]), int(found[1])


def _bands(own: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A key for each band of ``rows`` MinHashes of a set of hashes."""
    factors = mixed(np.arange(1, rows * bands + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 8192):
        np.minimum(least, (own[None, k : k + 8192] * factors[:, None]).min(axis=1), out=least)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys * np.uint64(0x100000001B3) + least[k::rows])
    return keys.view(np.int64)


def verified(values: np.ndarray, sets: list[np.ndarray], tree: np.ndarray, asked: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """Links (asked, tree) of places in ``values`` and ``sets`` that join what all links within the radius and of
    a Jaccard similarity of at least ``least`` would."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked, label, links = np.zeros(len(distinct), bool), np.arange(len(sets)), []
    for node, near in BKTree(values[tree]).within(values[asked], radius):
        t = tree[node]
        q = asked[near]
        q = q[(label[q] != label[t]) & (np.minimum(sizes[q], sizes[t]) >= least * np.maximum(sizes[q], sizes[t]) - 1e-9)]
        if not len(q):
            continue
        own = codes[ends[t] - sizes[t] : ends[t]]
        marked[own] = True
        if 4 * len(q) > len(sets):
            sums = np.append(0, np.cumsum(marked[codes]))
            common = sums[ends[q]] - sums[ends[q] - sizes[q]]
        else:
            common = np.array([np.count_nonzero(marked[codes[ends[x] - sizes[x] : ends[x]]]) for x in q])
        marked[own] = False
        q = q[common >= least * (sizes[q] + sizes[t] - common) - 1e-9]
        if len(q):
            merged, first = np.unique(label[q], return_index=True)
            links += [(int(x), int(t)) for x in q[first]]
            label[np.isin(label, merged)] = label[t]
    return links


def _verified_links(held: DataFrame, radius: int, least: float) -> DataFrame:
    """Edges (a, b) between ids of ``held`` (id, fp, keys, own), whose rows meet in the parts of the shards of their keys."""
    dealt = held.select("id", "fp", "own", F.explode("keys").alias("k")).select("id", "fp", "own", "k.key", "k.parts").withColumn("part", F.pmod(F.xxhash64("id", "fp"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    keys = ["key", "i", "j"]
    cells = dealt.withColumn("other", other).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "fp", "own")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _and_end(batches):
            own = [x for x in (rest, None if batch is None else pa.Table.from_batches([batch])) if x is not None]
            if not own:
                continue
            now = pa.concat_tables(own).combine_chunks()
            key, i, j, part, ids, fps = (now.column(k).to_numpy() for k in range(6))
            changes = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begins = np.concatenate([[0], changes]) if len(key) else np.empty(0, np.int64)
            ends = np.append(begins[1:], len(key))
            if batch is not None and len(begins):  # the last shard may go on in the next batch
                rest = now.slice(int(begins[-1]))
                begins, ends = begins[:-1], ends[:-1]
            texts, a, b = now.column(6), [], []
            for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in texts.slice(lo, hi - lo)]
                tree = asked = np.arange(hi - lo)
                if i[lo] != j[lo]:
                    tree, asked = tree[part[lo:hi] == i[lo]], tree[part[lo:hi] == j[lo]]
                for x, y in verified(fps[lo:hi].view(np.uint64), sets, tree, asked, radius, least):
                    a.append(ids[lo + x])
                    b.append(ids[lo + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long").filter("a <> b")


def _of_shards(each: DataFrame, shards: DataFrame, hot_rows: int) -> DataFrame:
    """``each`` (key and others) with the parts of its shard, without rows of other shards.

    Shards above ``hot_rows`` are few: at most one for so many rows of ``each``. They meet the rows in a join of
    their own, by broadcast while the table of them is small (spark.sql.autoBroadcastJoinThreshold), beyond it
    dealt over ``SALTS`` tasks each. So no task gets more than ``hot_rows`` rows of a key it was dealt whole.
    """
    hot, _ = written(shards.filter(F.col("n") > hot_rows).select("key", F.col("parts").alias("hot_parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "hot-shards")
    marked = each.withColumn("salt", F.pmod(F.xxhash64("id", "h1"), F.lit(SALTS)).cast("int")).join(hot, ["key", "salt"], "left").drop("salt")
    few = shards.filter(F.col("n") <= hot_rows).select("key", "parts")
    cold = marked.filter("hot_parts IS NULL").drop("hot_parts").join(few, "key")
    return cold.unionByName(marked.filter("hot_parts IS NOT NULL").withColumnRenamed("hot_parts", "parts").select(cold.columns))


def similar(documents: DataFrame, least: float = LEAST, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS, rows: int = 3, bands: int = 14, seed: int = SEED, shard_rows: int = 2048, shard_bytes: int = 32 << 20, hot_rows: int = 65_536) -> DataFrame:
    """doc_id, component_id of every row of ``documents``: the smallest doc_id that links can reach.

    Rows are linked if the sets of their word shingles have a Jaccard similarity of at least ``least``. Each
    link is verified by the whole sets. A pair of similarity s is a candidate if it shares one of ``bands``
    bands of ``rows`` MinHashes, with a chance of 1 - (1 - s**rows)**bands (0.9999 at 0.8), and if its
    fingerprints are within ``radius`` bits. Equal sets, empty ones too, are always linked. Rows with a null
    doc_id lend their component no id. Only doc_id and text are read.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                hashes = shingles(text.as_py().encode(), shingle, seed)
                own = np.unique(hashes)
                out.append((*_digest(own), np.uint64(majority(hashes)).view(np.int64), own.nbytes, _bands(own, rows, bands) if len(own) else None))
            h1, h2, fp, sizes, keys = list(zip(*out, strict=True)) or [[]] * 5
            whole = [pa.array(c, pa.int64()) for c in (h1, h2, fp, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *whole, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "fp", "bytes", "keys"])

    marked, _ = written(texts.mapInArrow(scan, "doc_id long, h1 long, h2 long, fp long, bytes long, keys array<long>"), "sketches")
    distinct, _ = written(marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "bytes", "keys")]), "distinct")
    each = distinct.filter("id IS NOT NULL").select("id", "h1", "fp", "bytes", F.explode("keys").alias("key"))
    # of shards that hold the same rows, one is searched
    held_by = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("id", "h1")).alias("x"), F.bit_xor(F.xxhash64("h1", "id")).alias("y")).filter("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / shard_rows), F.ceil(F.col("bytes") / shard_bytes), F.lit(1)).cast("int")
    shards, shards_path = written(held_by.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes")).select("key", "n", parts.alias("parts")), "shards")
    wanted = _of_shards(each, shards, hot_rows).groupBy("id", "h1", "fp").agg(F.collect_set(F.struct("key", "parts")).alias("keys"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(t.as_py().encode(), shingle, seed)) for t in batch.column(0)]
            same = pa.array([_digest(x)[0] for x in own], pa.int64())
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.tobytes() for x in own], pa.binary())], ["id", "h1", "fp", "keys", "own"])
            yield out.filter(pc.equal(same, batch.column(2)))

    read = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("text", "id", "h1", "fp", "keys").mapInArrow(sets, "id long, h1 long, fp long, keys array<struct<key:long,parts:int>>, own binary")
    held, path = written(read.groupBy("id", "h1", "fp").agg(F.first("keys").alias("keys"), F.first("own").alias("own")), "sets")
    removed(documents.sparkSession, shards_path)
    roots, _ = components(_verified_links(held, radius, least))
    removed(documents.sparkSession, path)
    known = distinct.join(roots, distinct["id"] == roots["node"], "left").select("h1", "h2", F.coalesce("root", "id").alias("component_id"))
    return marked.select("doc_id", "h1", "h2").join(known, ["h1", "h2"]).select("doc_id", "component_id")


def representatives(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, with all columns, without near-duplicates: of each component of ``similar`` the
    row of the smallest doc_id stays. Of rows that repeat this doc_id, the one of the smallest text stays. Rows
    with a null doc_id can't be told apart by it and stay."""
    found = similar(documents, **options)
    named = found.filter("doc_id IS NOT NULL")
    # written, so that Spark knows its size: few ids are broadcast (spark.sql.autoBroadcastJoinThreshold), and only many make the texts travel
    gone, _ = written(named.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    documents = documents.join(gone, "doc_id", "left_anti").select(documents.columns)
    again = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not again.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
        kept = documents.join(again, "doc_id", "left_semi").withColumn("__place", F.row_number().over(first)).filter("__place = 1").drop("__place")
        documents = documents.join(again, "doc_id", "left_anti").unionByName(kept.select(documents.columns))
    return documents


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
