"""How far a count stands out from the counts of the epochs before it."""

from __future__ import annotations

import math
from collections import Counter
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("delta", "measurement", "mean", "stddev", "mode", "percentile")


def detected(counts: dict[int, int], size: int, epoch: int, observations: int, mode: str = "sigma", sigma: float = 2.0, percentile: float = 0.0, least: int = 0) -> list[float] | None:
    """The values of ``FIELDS`` if the epoch's count exceeds its threshold, else null. ``counts``: those of the last
    ``size`` epochs, missing ones are 0. ``sigma``: the threshold is mean + sigma * stddev; ``modelfit``: the percentile of
    a normal distribution cut at 0, or, for means up to 1, of a geometric one."""
    last = max(counts, default=None)
    if last is None or not last - size < epoch <= last or not 0 < observations < size:
        return None
    seen = [counts.get(epoch - k, 0) for k in range(1, observations + 1)]
    here, mean = counts.get(epoch, 0), sum(seen) / observations
    spread = math.sqrt(sum((x - mean) ** 2 for x in seen) / observations) if observations > 1 else 0.0
    often = Counter(seen)
    most = max(often, key=lambda v: (often[v], v))
    share = -100.0
    if mode == "sigma":
        threshold = mean + sigma * spread
    elif mode == "modelfit":
        if mean == 0 or spread == 0:
            threshold = mean
        elif mean > 1:
            fit = NormalDist(mean, spread)
            below = fit.cdf(0)
            p = below + (1 - below) * percentile / 100
            threshold = fit.inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)
            share = (fit.cdf(here) - below) / (1 - below) * 100
        else:
            p = 1 / (1 + mean)
            threshold = max(0, math.ceil(math.log1p(-percentile / 100) / math.log1p(-p) - 1)) if percentile < 100 else math.inf
            share = (1 - (1 - p) ** (here + 1)) * 100
    else:
        raise ValueError(f"no mode {mode!r}")
    if here < least or not (here > threshold or mode == "modelfit" and percentile == 0):
        return None
    return [here - threshold, float(here), mean, spread, float(most), share]


def options_of(text: str, by: str) -> dict:
    given = dict(x.split(by) for x in text.split("~") if by in x)
    kinds = {"epoch": int, "obs": int, "sigma": float, "percentile": float, "min": int, "mode": str}
    names = {"obs": "observations", "min": "least"}
    return {names.get(k, k): kinds[k](v) for k, v in given.items() if k in kinds}


def anomaly(counts: Column, size: int, options: dict) -> Column:
    """``detected`` for an array of (name: epoch, hits)."""

    @F.pandas_udf("array<double>")
    def find(epochs: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else detected(dict(zip(map(int, e), map(int, h), strict=True)), size, **options) for e, h in zip(epochs, hits, strict=True)])

    return find(F.transform(counts, lambda x: x["name"].cast("bigint")), F.transform(counts, lambda x: x["hits"]))
