"""Substring dedup by sliding sentence spans (operator 7).

Texts are cut into pieces: sentences, which end at marks and line breaks, and within them clauses, which end
at commas, semicolons and colons. From each piece the shortest run of at least ``least`` pieces and ``words``
words forward, and backward, is hashed (128 bits). Hashes are joined globally, and pieces
covered by any occurrence of a repeated span but the first are removed. The first occurrence of a span is
the one in the smallest doc_id, and within a document the earliest.

To hash these shortest runs is to hash every run of at least so many pieces and words: each piece of a
longer run that repeats lies in one of its shortest runs, forward from the run's first pieces or backward from its last.

Hashes are made once, written, and dealt once: sorted, the first place of a hash is the one of the smallest document, so a
pass that holds one hash at a time finds all later ones. Hashes that fill more than a ten-thousandth of a sample of
documents (there are at most ten thousand of those) don't go that way: their smallest document comes from partial
aggregates and is joined by broadcast, so that no task gets all places of a hot hash. Which way a hash goes has no effect on the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.common import removed, table, written

#: What a full stop after them doesn't end. Single letters are taken for abbreviations, too.
ABBREVIATIONS = (b"Mr", b"Mrs", b"Ms", b"Dr", b"Prof", b"St", b"vs", b"Nr", b"bzw", b"Sr", b"Sra", b"Mme")
#: Marks before white space or the end, marks of scripts without spaces (U+3002, U+FF01, U+FF1F), and line breaks.
_BORDER = re.compile(rb"[.!?,;:][\"')\]]*(?=\s|\Z)|\xe3\x80\x82|\xef\xbc[\x81\x9f]|\n")
_ABBREVIATED = re.compile(rb"(?:\A|[\s.(])(?:[A-Za-z]|" + b"|".join(ABBREVIATIONS) + rb")\.\Z")
LEAST, WORDS = 1, 20
LAST = (1 << 63) - 1
#: Spans with more than one in HOT_SHARE of the places in one of SAMPLE documents are hot: a bound on their number.
HOT_SHARE, SAMPLE = 10_000, 64


def pieces_of(text: bytes) -> list[bytes]:
    """The pieces of a text; put together they are the text."""
    out, at = [], 0
    for m in _BORDER.finditer(text):
        end = m.end()
        if text[end - 1] == 46 and _ABBREVIATED.search(text[max(at, end - 8) : end]):
            continue
        out.append(text[at:end])
        at = end
    if at < len(text):
        out.append(text[at:])
    return out


def spans_of(pieces: list[bytes], least: int, words: int) -> tuple[list[int], dict[bytes, list[tuple[int, int]]]]:
    """Which of the pieces have words; and each span's hash with its (first, last) of those."""
    plain, where, sizes = [], [], [0]
    for k, piece in enumerate(pieces):
        own = piece.split()
        if own:
            plain.append(b" ".join(own))
            where.append(k)
            sizes.append(sizes[-1] + len(own))
    n = len(plain)
    if n < least or sizes[-1] < words:
        return where, {}
    total = np.array(sizes)
    begin = np.arange(n)
    forward = np.maximum(np.searchsorted(total, total[:-1] + words) - 1, begin + least - 1)
    backward = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, begin - least + 1)
    runs = {(i, e) for i, e in zip(begin.tolist(), forward.tolist(), strict=True) if e < n}
    runs |= {(b, e) for b, e in zip(backward.tolist(), begin.tolist(), strict=True) if b >= 0}
    digest = xxhash.xxh3_128_digest
    found: dict[bytes, list[tuple[int, int]]] = {}
    for i, e in sorted(runs):
        found.setdefault(digest(b"\n".join(plain[i : e + 1])), []).append((i, e))
    return where, found


def _hashes(documents: DataFrame, least: int, words: int) -> DataFrame:
    """doc, h1, h2 (96 bits of the hashes of the distinct spans), twice (whether a span has several places) of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [spans_of(pieces_of((t.as_py() or "").encode()), least, words)[1] for t in part.column(1)]
                halves = [np.frombuffer(b"".join(f), np.int64).reshape(-1, 2) for f in found]
                ends = pa.array(np.cumsum([0, *map(len, halves)]), pa.int32())
                both = np.concatenate(halves) if halves else np.empty((0, 2), np.int64)
                columns = [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(both[:, 1].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.ListArray.from_arrays(ends, c) for c in columns), pa.array([any(len(x) > 1 for x in f.values()) for f in found], pa.bool_())], ["doc", "h1", "h2", "twice"])

    return documents.mapInArrow(scan, "doc long, h1 array<long>, h2 array<int>, twice boolean")


def _after_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, h1 of the rows (sorted by h1, h2, doc) of which the first of the same hash has a smaller doc."""
    last = None
    for batch in batches:
        h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
        if not len(h1):
            continue
        new = np.concatenate([[last is None or (h1[0], h2[0]) != last[:2]], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        firsts = np.flatnonzero(new)
        least = np.empty(len(h1), np.int64)
        if not new[0]:
            least[: firsts[0] if len(firsts) else len(h1)] = last[2]
        if len(firsts):
            least[firsts[0] :] = np.repeat(doc[firsts], np.diff(np.append(firsts, len(h1))))
        last = (h1[-1], h2[-1], least[-1])
        later = doc > least
        yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(h1[later])], ["doc", "h1"])


def _later(hashes: DataFrame) -> DataFrame:
    """doc, later (h1 of spans that a smaller document has, too) of the documents that lose something."""
    keys = ["h1", "h2"]
    places = hashes.select("doc", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("h.h1", "h.h2", "doc")
    sample = places.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    most = (hashes.agg(F.sum(F.size("h1").cast("long"))).first()[0] or 0) // (SAMPLE * HOT_SHARE)
    hot = sample.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > max(1, most)).orderBy(F.desc("n")).limit(HOT_SHARE).select(*keys)
    hot, _ = written(hot, "spans-hot")  # at most HOT_SHARE
    firsts = places.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.min("doc").alias("lo"))
    of_hot = places.join(F.broadcast(firsts), keys).filter("doc > lo").select("doc", "h1")
    rest = places.join(F.broadcast(hot), keys, "left_anti").repartition(*keys).sortWithinPartitions(*keys, "doc")
    found = rest.mapInArrow(_after_first, "doc long, h1 long").unionAll(of_hot)
    inside = hashes.filter("twice").select("doc", F.lit(None).cast("long").alias("h1"))
    return found.unionAll(inside).groupBy("doc").agg(F.collect_set("h1").alias("later"))


def deduplicated(documents: DataFrame, least: int = LEAST, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns ``carry``, n_sentences, n_removed of every row: its text without repeated spans.

    Pieces (counted as sentences) end at ``.``, ``!``, ``?``, ``,``, ``;``, ``:`` before white space, at marks of scripts
    without spaces, and at line breaks; not after abbreviations. They are compared by their words, white space aside.
    Pieces without words are no sentences and stay. Null texts are empty. Rows with a null doc_id come
    after all others and don't displace each other, nor do rows with the same doc_id. Texts of fewer than
    ``least`` pieces or ``words`` words have no span and stay whole; very long texts are held whole by one task. Repeated rows are repeated in
    the result. Only doc_id, text and ``carry`` are read. An empty table gives an empty result.
    """
    spark, doc_id = documents.sparkSession, F.col("doc_id").cast("long")
    docs = documents.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(doc_id.alias("doc_id"), *carry).alias("other"))
    hashes, path = written(_hashes(docs.select("doc", "text"), least, words), "spans")
    later, _ = written(_later(hashes), "spans-later")
    removed(spark, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, later in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                pieces = pieces_of(raw)
                if not later.is_valid:
                    out.append((raw.decode(), sum(1 for p in pieces if p.strip()), 0))
                    continue
                where, found = spans_of(pieces, least, words)
                gone = set(later.values.to_numpy().tolist())
                lost = np.zeros(len(where) + 1, bool)
                for h, places in found.items():
                    for i, e in places if int.from_bytes(h[:8], "little", signed=True) in gone else places[1:]:
                        lost[i : e + 1] = True
                drop = {where[k] for k in np.flatnonzero(lost)}
                kept = b"".join(p for k, p in enumerate(pieces) if k not in drop) if drop else raw
                out.append((kept.decode(), len(where), len(drop)))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)), batch.column(2)], ["text", "n_sentences", "n_removed", "other"])

    found = docs.join(later, "doc", "left").select("text", "later", "other")
    kept = found.mapInArrow(cut, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType()), docs.schema["other"]]))
    return kept.select("other.doc_id", "text", *[F.col(f"other.{c}") for c in carry], "n_sentences", "n_removed")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
