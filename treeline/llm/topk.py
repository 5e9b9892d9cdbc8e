"""Exact top-k search (operator 2): tiled matrix products and merged top lists.

Vectors are packed into blocks. Each block of queries meets each block of candidates in one tile: a
matrix product, of which every query keeps its k best. Candidates are dealt to slots and stream past
the queries, which a task holds together with their lists so far; queries of more than ``GROUP_BYTES``
make several groups, which see all candidates each. The lists of a query are merged in two levels.
Queries travel once to each slot, so slots follow the cores and not the input. Copies are made one by
one in Python: a row that Spark's explode copies is held in all its copies at once. Nothing is
broadcast, and the driver gets one sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import table, written

PACKED = "dim int, size int, ids binary, cells binary"
DEALT = "cell int, side int, first long, " + PACKED
_LIMIT = 2.0**53
_LIMIT32 = 2.0**24
#: Most bytes of a block, as doubles; and of the queries that a task holds, with their lists.
BLOCK_BYTES = 1 << 22
GROUP_BYTES = 96 << 20
#: Candidates of a tile; and of a run, of which only the best is looked at first.
TILE, RUN = 2048, 32


def packed(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """Blocks of at most ``rows`` sound vectors of one dimension, by vec_id: floor(scale * x) in ``size`` 2 bytes where that fits, else x as doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls are NaN
            begins = np.concatenate([[0], np.cumsum(lengths)])
            unsound = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            sound = unsound[begins[1:]] == unsound[begins[:-1]]
            for dim in np.unique(lengths[sound]):
                which = np.flatnonzero(sound & (lengths == dim))
                which = which[np.argsort(ids[which], kind="stable")]
                most = min(rows, max(1, BLOCK_BYTES // (8 * max(1, dim))))
                for part in np.array_split(which, -(-len(which) // most)):
                    cells = flat[begins[part][:, None] + np.arange(dim)] if dim else np.empty((len(part), 0))
                    cells = cells.astype(np.float64)
                    with np.errstate(over="ignore"):
                        scaled = np.floor(scale * cells)
                    if np.abs(scaled).max(initial=0) < 1 << 15:
                        cells = scaled.astype(np.int16)
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "size": pa.array([cells.itemsize], pa.int32()), "ids": [ids[part].astype(np.int64).tobytes()], "cells": [cells.tobytes()]})

    return vectors.mapInArrow(pack, PACKED)


def whole(cells: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; in Python's integers where that isn't a double."""
    with np.errstate(over="ignore"):
        found = np.floor(scale * cells)
    if np.isfinite(found).all():
        return found
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in cells.tolist()], dtype=object)


def largest(cells: np.ndarray) -> float:
    """The largest magnitude of whole components; of Python's integers, infinity."""
    return math.inf if cells.dtype == object else float(np.abs(cells).max(initial=0))


def exact(a: float, b: float, dim: int) -> type | None:
    """Floats in which inner products, and all partial sums, of whole components of magnitudes up to a and b are exact."""
    most = max(1, a) * max(1, b) * max(1, dim)
    return np.float32 if most < _LIMIT32 else np.float64 if most < _LIMIT else None


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 2**53 in Python's integers, held within a long."""
    if kind := exact(largest(a), largest(b), a.shape[1]):
        return a.astype(kind) @ b.astype(kind).T
    low, high = -(1 << 63), (1 << 63) - 1
    x, y = ([[int(v) for v in row] for row in m.tolist()] for m in (a, b))
    return np.array([[min(high, max(low, sum(p * q for p, q in zip(r, s, strict=True)))) for s in y] for r in x], dtype=object)


class Asked:
    """A block of queries and their k best so far: score, then the smaller vec_id."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, k: int):
        self.ids, self.cells, self.k = ids, cells, k
        self.scores, self.found = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.count = np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, cells: np.ndarray, most: float, scale: int, buffers: dict) -> None:
        """One tile: candidates in the order of their ids, their whole components and the largest of these."""
        own = self.cells if self.cells.dtype == np.int16 else whole(self.cells, scale)
        kind = exact(largest(own), most, own.shape[1])
        if kind is None:
            rows, columns = np.nonzero(self.ids[:, None] != ids[None, :])
            self.take(rows, ids[columns], products(own, cells)[rows, columns].astype(np.int64))
            return
        runs = -(-len(ids) // RUN)
        shape = (runs * RUN, len(own))
        room = buffers.get(kind)
        if room is None or room.size < shape[0] * shape[1]:
            room = buffers[kind] = np.empty(shape[0] * shape[1], kind)
        scores = room[: shape[0] * shape[1]].reshape(shape)
        np.matmul(cells.astype(kind, copy=False), own.astype(kind).T, out=scores[: len(ids)])
        scores[len(ids) :] = -np.inf
        begin, end = np.searchsorted(ids, self.ids, "left"), np.searchsorted(ids, self.ids, "right")
        for i in np.flatnonzero(begin < end):
            scores[begin[i] : end[i], i] = -np.inf
        scores = scores.reshape(runs, RUN, len(own))
        tops = scores.max(axis=1)
        last = np.where(self.count == self.k, self.scores[:, -1], np.finfo(np.float32).min)  # above -inf, below all scores
        better = (tops > last) | ((tops == last) & (ids[::RUN, None] < self.found[:, -1]))
        many = np.flatnonzero(np.count_nonzero(better, axis=0) > self.k)
        if len(many):  # the k-th of the runs' best is a bound, too
            last[many] = np.maximum(last[many], np.partition(tops[:, many], -self.k, axis=0)[-self.k])
            better[:, many] &= tops[:, many] >= last[many]
        run, rows = np.nonzero(better)
        if len(run):
            scores = scores[run, :, rows]
            i, j = np.nonzero(scores >= last[rows, None].astype(kind))
            self.take(rows[i], ids[run[i] * RUN + j], scores[i, j].astype(np.int64))

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge further candidates into the lists of their rows."""
        touched = np.unique(rows)
        old, place = np.nonzero(np.arange(self.k) < self.count[touched][:, None])
        old = touched[old]
        rows, ids, scores = (np.concatenate(x) for x in ((old, rows), (self.found[old, place], ids), (self.scores[old, place], scores)))
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        stay = place < self.k
        self.found[rows[stay], place[stay]], self.scores[rows[stay], place[stay]] = ids[stay], scores[stay]
        self.count[touched] = np.bincount(rows[stay], minlength=len(self.ids))[touched]

    def lists(self, part: int) -> pa.RecordBatch:
        rows, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        return pa.RecordBatch.from_pydict({"query_id": self.ids[rows], "vec_id": self.found[rows, place], "score": self.scores[rows, place], "part": np.full(len(rows), part, np.int32)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, tile_rows: int = 4096, query_rows: int = 512, slots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all ``vectors`` for each row of ``queries``.

    Both have columns vec_id and embedding. The score is the integer inner product of
    floor(scale * component), exact for all finite components and held within a long; ties go to the smaller vec_id. Rows with the query's own vec_id are no
    candidates of it. Vectors that are null or hold nulls or non-finite components, and rows without a
    vec_id, take no part; vectors are compared with those of their own dimension. Repeated candidate
    rows count each; of repeated query rows (same vec_id) the smallest vector is used. Empty tables
    give no rows, and a query with fewer than k candidates gets them all.
    """
    spark = vectors.sparkSession
    slots = slots or max(4 * spark.sparkContext.defaultParallelism, min(48, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = math.isqrt(slots - 1) + 1

    def typed(df: DataFrame) -> DataFrame:
        kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")

    sound = typed(queries).filter("NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    asked, _ = written(packed(sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), query_rows, scale), "top-k-queries")
    total = asked.agg(F.sum(F.length("cells") + F.length("ids") * (2 * k + 2))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))

    def dealt(blocks: DataFrame, side: int) -> DataFrame:
        """Queries (0) to all slots of a group, candidates (1) to a slot of all groups."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = TaskContext.get().partitionId() * 7919
            for batch in batches:
                for row in range(batch.num_rows):
                    one = batch.slice(row, 1)
                    first = int(np.frombuffer(one.column(2)[0].as_buffer(), np.int64, 1)[0])
                    turn += 1
                    cells = (turn % groups * slots + s for s in range(slots)) if side == 0 else (g * slots + turn % slots for g in range(groups))
                    for cell in cells:
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([side], pa.int32()), pa.array([first], pa.int64()), *one.columns], ["cell", "side", "first", *one.schema.names])

        return blocks.mapInArrow(deal, DEALT)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, buffers = None, {}, {}
        for batch in batches:
            for row in range(batch.num_rows):
                cell, side, _, dim, size, ids, cells = (batch.column(i)[row].as_py() for i in range(7))
                if cell != at:
                    yield from (x.lists(at % slots % parts) for blocks in held.values() for x in blocks)
                    at, held = cell, {}
                ids = np.frombuffer(ids, np.int64)
                cells = np.frombuffer(cells, np.int16 if size == 2 else np.float64).reshape(len(ids), dim)
                if side == 0:
                    held.setdefault(dim, []).append(Asked(ids, cells, k))
                elif dim in held:
                    cells = cells.astype(np.float32) if size == 2 else whole(cells, scale)
                    for begin in range(0, len(ids), TILE):
                        some = cells[begin : begin + TILE]
                        most = largest(some)
                        for x in held[dim]:
                            x.meet(ids[begin : begin + TILE], some, most, scale, buffers)
        yield from (x.lists(at % slots % parts) for blocks in held.values() for x in blocks)

    tiles = dealt(asked, 0).unionAll(dealt(packed(typed(vectors), tile_rows, scale), 1)).repartitionById(groups * slots, F.col("cell")).sortWithinPartitions("cell", "side", "first")
    lists = tiles.mapInArrow(search, "query_id long, vec_id long, score long, part int")
    order = [F.desc("score"), F.asc("vec_id")]
    for keys in (["query_id", "part"], ["query_id"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
