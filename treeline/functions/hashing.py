"""Hashes that Spark has no function for: 32-bit Murmur3 of UTF-16LE texts, and the Java string hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def murmur3_utf16(text: str, seed: int = 0) -> int:
    """Murmur3 x86_32 of the text's UTF-16LE bytes, as a signed number."""
    data = text.encode("utf-16-le", "surrogatepass")
    mask, h = 0xFFFFFFFF, seed
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    whole = len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        h = (rotate(h ^ rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= rotate(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def java_hash(text: str) -> int:
    h = 0
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (31 * h + unit) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def _vectorised(f):
    @F.pandas_udf("long")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore").astype("Int64")

    return apply


def murmur3(value: Column) -> Column:
    return _vectorised(murmur3_utf16)(value.cast("string"))


def java_hash_code(value: Column) -> Column:
    return _vectorised(java_hash)(value.cast("string"))


def in_shard(value: Column, shards: int, mine: list[int]) -> Column:
    """Whether abs(murmur3) % shards is one of mine."""
    return F.pmod(F.abs(murmur3(value)), F.lit(shards)).isin(mine)
