"""Quality classifier (operator 3): regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics. For each class the mean and the covariance come from
sums over all training rows; covariances are shrunk towards the pooled covariance and its diagonal, and
their Cholesky factors are kept. What separates the classes is the difference of their log densities
(Mahalanobis distances and log determinants) plus that of the log priors. A score is the logistic function of a line
of that difference; slope and shift are fitted to the training rows, because the statistics are not normal and the raw
difference is far too sure of itself. Nothing of the rows held out is used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.common import table, written

_SENTENCE = re.compile(rb"[.!?]+")
_KIND = np.zeros(256, np.uint8)
_UPPER, _LOWER, _DIGIT, _SPACE, _POINT, _SYMBOL, _HIGH = range(1, 8)
for _c in range(256):
    _KIND[_c] = (
        _HIGH if _c >= 128 else _UPPER if 65 <= _c <= 90 else _LOWER if 97 <= _c <= 122 else _DIGIT if 48 <= _c <= 57
        else _SPACE if _c in b" \t\n\r\v\f" else _POINT if _c in b".,;:?'\"-()" else _SYMBOL
    )

NAMES = ("log_words", "word_length", "word_length_spread", "upper", "digits", "points", "symbols", "high", "distinct", "top_word", "repeats", "pair_repeats", "line_repeats", "sentence_length", "short_words", "marked_words")


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``NAMES``; shares go
    through a logit and, in short texts, towards a usual value."""
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8).tolist()
    words = raw.split()
    n, size = len(words), len(raw)
    letters = kinds[_UPPER] + kinds[_LOWER]
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = len(_SENTENCE.findall(raw))
    marked = sum(1 for w in counts if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:?"))
    return [
        math.log1p(n),
        math.log((int(lengths.sum()) + 50) / (n + 10)),
        math.log1p(math.sqrt((float(((lengths - lengths.mean()) ** 2).sum() if n else 0) + 60) / (n + 10))),
        _logit(kinds[_UPPER], letters, 50, 0.03),
        _logit(kinds[_DIGIT], size, 100, 0.002),
        _logit(kinds[_POINT], size, 100, 0.03),
        _logit(kinds[_SYMBOL], size, 100, 0.001),
        _logit(kinds[_HIGH], size, 100, 0.05),
        math.log((len(counts) + 20) / (n + 20) ** 0.8),
        _logit(max(counts.values(), default=0), n, 30, 0.06),
        _logit(repeats, n, 20, 0.005),
        _logit(max(0, n - 1 - pairs), n, 20, 0.01),
        _logit(len(lines) - len(set(lines)), len(lines), 5, 0.01),
        math.log((n + 20) / (sentences + 2)),
        _logit(int((lengths <= 3).sum()), n, 20, 0.35),
        _logit(marked, len(counts), 20, 0.01),
    ]


def _logit(part: int, whole: int, weight: float, usual: float) -> float:
    """The logit of a share, drawn towards its usual value as ``weight`` more cases of that value would."""
    return math.log((part + weight * usual) / (whole - part + weight * (1 - usual)))


def features(documents: DataFrame) -> DataFrame:
    """doc_id, x of every row; null texts are empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, x array<double>")


@dataclass
class Model:
    """Class means, the inverses of the Cholesky factors, and the constants of the log densities."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0; statistics are held within eight deviations."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(x) + self.shift, -30, 30)))


def moments(training: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class: the number of rows, the sum of x and of x x'. Sums of rows with columns x, label."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                x = np.hstack([np.ones((len(x), 1)), x])
                label = batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(label):
                    own = x[label == c]
                    total[int(c)] = total.get(int(c), 0) + own.T @ own
        rows = [(c, k, float(v)) for c, m in total.items() for k, v in enumerate(m.ravel())]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["label", "k", "v"])

    found: dict[int, np.ndarray] = {}
    size = len(NAMES) + 1
    for r in training.select("x", "label").mapInArrow(sums, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["label"], np.zeros(size * size))[r["k"]] = r["v"]
    return {c: ((m := v.reshape(size, size))[0, 0], m[0, 1:], m[1:, 1:]) for c, v in found.items()}


def fitted(training: DataFrame, shrinkage: float = 0.2, ridge: float = 0.05) -> Model | float:
    """The model of rows with columns x and label (0 or 1); a constant score where a class has no row."""
    by = moments(training)
    if not by.get(0, (0,))[0] or not by.get(1, (0,))[0]:
        return 1.0 if by.get(1, (0,))[0] else 0.0 if by.get(0, (0,))[0] else 0.5
    total = by[0][0] + by[1][0]
    centre = (by[0][1] + by[1][1]) / total
    means = {c: by[c][1] / by[c][0] for c in (0, 1)}
    within = {c: by[c][2] / by[c][0] - np.outer(means[c], means[c]) for c in (0, 1)}
    pooled = (by[0][0] * within[0] + by[1][0] * within[1]) / total
    scale = np.sqrt(np.maximum(np.diag((by[0][2] + by[1][2]) / total - np.outer(centre, centre)), 1e-9))
    factors, constants = [], []
    unit = np.outer(scale, scale)
    for c in (0, 1):
        share = shrinkage + (1 - shrinkage) * len(NAMES) / (len(NAMES) + by[c][0])
        cov = (1 - share) * within[c] / unit + share * pooled / unit
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled / unit) + 1.0)
        root = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(root))
        constants.append(math.log(by[c][0] / total) - np.log(np.diag(root)).sum())
    model = Model(centre, scale, np.array([(means[c] - centre) / scale for c in (0, 1)]), np.array(factors), np.array(constants))
    model.slope, model.shift = calibrated(model, training)
    return model


#: Differences are counted in bins of this width, up to this many on each side.
BIN, BINS = 0.25, 400


def calibrated(model: Model, training: DataFrame) -> tuple[float, float]:
    """Slope and shift of the least log loss over the training rows, from counts by label and bin of the difference."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = model.differences(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.clip(np.round(d / BIN), -BINS, BINS).astype(np.int32))], ["label", "bin"])

    counts = training.select("x", "label").mapInArrow(bins, "label int, bin int").groupBy("label", "bin").count().collect()  # at most 2 * (2 * BINS + 1) rows
    label, d, n = (np.array([r[k] for r in counts], float) for k in ("label", "bin", "count"))
    ones, zeros = n[label == 1].sum(), n[label == 0].sum()
    wanted = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    line, at = np.stack([d * BIN / 10, np.ones(len(d))]), np.array([1.0, 0.0])
    for _ in range(60):  # Newton steps; the little ridge keeps separable rows from an endless slope
        p = 1 / (1 + np.exp(-np.clip(at @ line, -30, 30)))
        slope = line @ (n * (wanted - p)) - 1e-3 * at
        step = np.linalg.solve((line * (n * p * (1 - p))) @ line.T + 1e-3 * np.eye(2), slope)
        at = at + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (max(at[0], 1e-3) / 10, at[1])


def _remainder(held_out: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out


def _taught(x: DataFrame, labels: DataFrame, held_out: int) -> DataFrame:
    """x, label of the labelled rows of ``x`` that are not held out."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1)).filter(_remainder(held_out) != 0)
    return x.join(taught, "doc_id")


def _scores(model: Model | float, rows) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(rows), model)
    return np.round(model.scores(np.stack(rows)), 9) if len(rows) else np.empty(0)


def accepted(documents: DataFrame, labels: DataFrame, held_out: int = 5, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents``, with all columns, that ``scored`` would predict as 1. The statistics are written once, beside the rows."""
    text, name = documents.columns.index("text"), "x"
    while name in documents.columns:
        name += "_"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, name])

    marked, _ = written(documents.mapInArrow(scan, T.StructType([*documents.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])), "statistics")
    x = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("x"))
    model = documents.sparkSession.sparkContext.broadcast(fitted(_taught(x, labels, held_out)))

    @F.pandas_udf("boolean")
    def good(x: pd.Series) -> pd.Series:
        return pd.Series(_scores(model.value, x.to_numpy()) >= threshold)

    return marked.filter(good(F.col(name))).select(documents.columns)


def scored(documents: DataFrame, labels: DataFrame, held_out: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``.

    Rows whose crc32(doc_id as text) mod ``held_out`` is 0 are held out of the training; their labels are
    never read. Labels that are neither 0 nor 1, or have no document, don't count; repeated label rows count
    each. A null doc_id is not held out and has no label. Null and empty texts have the statistics' usual values. If
    the labels lack a class, every score is 1, 0 or (no labels) 0.5. Repeated rows are repeated in the
    result. Only doc_id and text, and doc_id and quality, are read.
    """
    x, _ = written(features(documents), "features")
    model = x.sparkSession.sparkContext.broadcast(fitted(_taught(x, labels, held_out)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scores(model.value, batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    done = x.mapInArrow(score, "doc_id long, score double, predicted int")
    return done.select("doc_id", F.coalesce(_remainder(held_out) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
