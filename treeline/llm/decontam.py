"""Benchmark decontamination (operator 10): size-partitioned MinHash containment search.

Test items are partitioned by size: by the length of their shingles, and by the power of two below their
number of distinct shingles. An item's sketch is its bottom-k MinHash over word shingles, where one k
serves a partition: a document that holds a share ``threshold`` of n shingles lacks at most
n - ceil(threshold * n) of them, so it holds at least one of any n - ceil(threshold * n) + 1, and
the smallest hashes serve as well as any others; k is the greatest of the partition. Documents of too few
shingles for a partition's smallest item pass it by. Every other shingle of every document is looked up in
the partition's sketches, and each pair found is verified by exact containment of shingle strings. No true
pair is lost.

Items are the query set. They are sent to the executors in blocks of a fixed number of items and bytes;
each block scans the documents once more, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import shingle_hashes, table, word_hashes

_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
WORDS, THRESHOLD = 5, 0.8
BLOCK_ITEMS, BLOCK_BYTES, LEADING = 20_000, 32_000_000, 20


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())


def shingles_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


class Sketches:
    """The sketches of one block of items, partitioned by length of shingle and by size of item."""

    def __init__(self, items: list[tuple[int, str]], words: int, threshold: float):
        self.items, self.threshold = [], threshold
        members: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            raw = (text or "").encode()
            own = words_of(raw)
            n = min(words, len(own))
            if not n:
                continue
            shingles = shingles_of(own, n)
            members[n, len(shingles).bit_length()].append((len(self.items), np.unique(shingle_hashes(word_hashes(raw), n))))
            self.items.append((item_id, n, shingles))
        self.partitions = [(n, *self._index(own)) for (n, _), own in sorted(members.items())]
        # which leading bits the hashes of all partitions have: most shingles of a document end here
        self.leading = {n: np.zeros(1 << LEADING, bool) for n, *_ in self.partitions}
        for n, _, keys, _ in self.partitions:
            self.leading[n][keys >> np.uint64(64 - LEADING)] = True

    def _index(self, own: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray, list[list[int]]]:
        """The least number of shingles a document needs for one of the items, hashes in order, and the items of each hash."""
        sizes = [len(self.items[k][2]) for k, _ in own]
        depth = max(n - needed(n, self.threshold) + 1 for n in sizes)
        found: dict[int, list[int]] = defaultdict(list)
        for k, hashes in own:
            for h in hashes[:depth].tolist():
                found[h].append(k)
        keys = np.array(sorted(found), np.uint64)
        return min(needed(n, self.threshold) for n in sizes), keys, [found[h] for h in keys.tolist()]

    def candidates(self, text: bytes) -> set[int]:
        hit: set[int] = set()
        hashes = word_hashes(text) if self.partitions else None
        of_length: dict[int, tuple[int, np.ndarray]] = {}
        for n, least, keys, owners in self.partitions:
            if n not in of_length:
                own = shingle_hashes(hashes, n)
                of_length[n] = len(own), own[self.leading[n][own >> np.uint64(64 - LEADING)]]
            size, own = of_length[n]
            if size < least:
                continue
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            for k in np.unique(at[keys[at] == own]):
                hit.update(owners[k])
        return hit

    def verified(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item_id, shared shingles, shingles of the item, containment) of the items that the text holds."""
        out, own = [], None
        grams: dict[int, set[bytes]] = {}
        for k in sorted(self.candidates(text)):
            item_id, n, shingles = self.items[k]
            own = words_of(text) if own is None else own
            if n not in grams:
                grams[n] = shingles_of(own, n)
            both = len(shingles & grams[n])
            if both >= needed(len(shingles), self.threshold):
                out.append((item_id, both, len(shingles), both / len(shingles)))
        return out


def needed(n: int, threshold: float) -> int:
    """The least number of n shingles that reaches the threshold."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def blocks_of(items: DataFrame, most: int, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 100
        if len(block) >= most or size >= most_bytes:
            yield block
            block, size = [], 0
    yield block


FOUND = "doc_id long, item_id long, n_shared int, n_item int, containment double"


def contained(documents: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each pair whose containment reaches ``threshold``.

    Containment is the share of the item's distinct shingles that the document holds. Words are maximal
    runs of ASCII letters (A-Z as a-z), digits and non-ASCII characters; shingles are ``words`` of them,
    or all of an item of fewer. Items without words match nothing, nor do null or empty documents.
    Repeated rows give repeated pairs; rows with a null id are compared like others, under a null id.
    Only doc_id, text, item_id are read. Empty tables give an empty result.
    """
    spark, docs = documents.sparkSession, documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = None
    for block in blocks_of(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), block_items, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value, words, threshold)
            for batch in batches:
                out = [(doc_id, *f) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for f in sketches.verified((text.as_py() or "").encode())]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        found = docs.mapInArrow(search, FOUND)
        result = found if result is None else result.unionAll(found)
    return result


def clean(documents: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, with all columns, that hold no item as ``contained`` would find it."""
    spark, text = documents.sparkSession, documents.columns.index("text")
    for block in blocks_of(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), block_items, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value, words, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not sketches.verified((t.as_py() or "").encode()) for t in batch.column(text)], pa.bool_()))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') FROM benchmark
), sizes AS (
  SELECT DISTINCT least(5, len(w)) AS n FROM w WHERE kind = 1 AND len(w) > 0
), s AS (
  SELECT DISTINCT kind, id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM w JOIN sizes ON len(w) >= n AND (kind = 0 OR n = least(5, len(w)))
), c AS (
  SELECT id, n, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY ALL
), p AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i USING (n, g) WHERE d.kind = 0 AND i.kind = 1 GROUP BY ALL
)
SELECT doc_id, item_id, n_shared::INTEGER AS n_shared, n_item::INTEGER AS n_item, n_shared::DOUBLE / n_item AS containment
FROM p JOIN c ON item_id = id WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""
