"""Sketches: Bloom filters as bitmaps, and reading count-min sketches."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap that Spark's bitmap functions make, and how many of them a hash may have (a filter of four hashes then has 64 MB).
BITS, MOST_MAPS = 32_768, 4096


def _map_holds(error: float, hashes: int) -> float:
    """Values a bitmap, so that one in 1 / ``error`` others passes. Each hash has bits of its own: after n values
    (1 - exp(-n / bits)) ** hashes pass."""
    return -math.log(1 - error ** (1 / hashes)) * BITS


def bloom_maps(most: int | None, error: float, hashes: int) -> int:
    """Bitmaps a hash of a filter for ``most`` values, at least one."""
    maps = max(1, math.ceil((most or 0) / _map_holds(error, hashes)))
    if maps > MOST_MAPS:
        raise ValueError(f"a filter of {most} values with an error of {error} needs {maps} bitmaps a hash, more than {MOST_MAPS}")
    return maps


def _place(value: Column, k: int, maps: Column) -> Column:
    text, bits = value.cast("string"), F.lit(BITS) * maps
    return F.pmod(F.pmod(F.xxhash64(text, F.lit(1)), bits) + F.lit(k) * F.pmod(F.xxhash64(text, F.lit(2)), bits), bits)


def bloom_filters(pairs: DataFrame, to: str, hashes: int, most: int | None, error: float) -> DataFrame:
    """path, and in ``to`` a Bloom filter of its names, from the different pairs of path and name: an array of bitmaps, those of
    each hash one after the other; as many a hash as the path's names need for the error, but no fewer than ``most`` need."""
    needed = F.ceil(F.count("*") / F.lit(_map_holds(error, hashes)))
    sizes = pairs.groupBy("path").agg(F.greatest(needed, F.lit(bloom_maps(most, error, hashes))).cast("long").alias("maps"))
    many = F.raise_error(F.concat(F.lit(f"a filter with an error of {error} needs more than {MOST_MAPS} bitmaps a hash: "), F.col("maps").cast("string")))
    sizes = sizes.withColumn("maps", F.when(F.col("maps") > MOST_MAPS, many.cast("long")).otherwise(F.col("maps")))
    places = [(_place(F.col("name"), k, F.col("maps")), F.lit(k) * F.col("maps")) for k in range(hashes)]
    bits = F.array(*[F.struct((first + F.floor(p / BITS)).alias("map"), F.pmod(p, F.lit(BITS)).alias("bit")) for p, first in places])
    set_bits = pairs.join(sizes, "path").select("path", F.explode(bits).alias("b")).select("path", "b.map", "b.bit")
    empty = sizes.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes) * F.col("maps") - 1)).alias("map"), F.lit(None).cast("long").alias("bit"))
    maps = set_bits.unionByName(empty).groupBy("path", "map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    listed = F.array_sort(F.collect_list(F.struct("map", "bits")))
    return maps.groupBy("path").agg(F.transform(listed, lambda x: x["bits"]).alias(to))


def empty_bloom(hashes: int, most: int | None, error: float) -> Column:
    return F.array_repeat(F.lit(bytes(BITS // 8)), hashes * bloom_maps(most, error, hashes))


def bloom_bytes(bloom: Column) -> Column:
    """The filter as one binary."""
    return F.unhex(F.array_join(F.transform(bloom, lambda x: F.hex(x)), ""))


def bloom_share(bloom: Column) -> Column:
    """How many percent of the bits are set."""
    return F.floor(bloom_size(bloom) * 100 / (F.size(bloom) * F.lit(BITS).cast("long")))


def in_bloom(bloom: Column, value: Column, hashes: int, whole: bool = False) -> Column:
    """Whether a filter may hold the value; null for a null value. Its length tells how many bitmaps a hash has. A look into an array
    of bitmaps copies one of them, a look into one binary (``whole``) of a row all of it."""
    maps = F.call_function("div", F.octet_length(bloom) if whole else F.size(bloom), F.lit(hashes * (BITS // 8) if whole else hashes))
    found = F.lit(True)
    for k in range(hashes):
        place = _place(value, k, maps)
        if whole:
            part, at = bloom, F.floor(place / 8) + k * maps * (BITS // 8)
        else:
            part, at = F.get(bloom, (F.floor(place / BITS) + k * maps).cast("int")), F.floor(F.pmod(place, F.lit(BITS)) / 8)
        byte = F.conv(F.hex(F.substr(part, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1)
    return F.when(value.isNotNull(), found)


def bloom_size(bloom: Column) -> Column:
    """How many bits are set."""
    return F.aggregate(bloom, F.lit(0).cast("long"), lambda n, x: n + F.bitmap_count(x))


def _signed(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def _murmur(data: bytes, seed: int) -> int:
    """Murmur3 as Spark has it for bytes: whole words, then each byte that is left as a word of its own."""
    mask, h = 0xFFFFFFFF, seed & 0xFFFFFFFF
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    whole = len(data) // 4 * 4
    words = [*struct.unpack(f"<{whole // 4}i", data[:whole]), *struct.unpack(f"{len(data) - whole}b", data[whole:])]
    for w in words:
        h = (rotate(h ^ rotate((w & mask) * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return _signed(h ^ h >> 16)


def count_min_estimate(sketch: bytes, value: str | None) -> int | None:
    """A value's count (null: the total) in what the aggregate ``count_min_sketch`` of texts has made."""
    _, total, depth, width = struct.unpack_from(">iqii", sketch)
    if value is None:
        return total
    raw = value.encode()
    a = _murmur(raw, 0)
    b = _murmur(raw, a)
    counts = []
    for k in range(depth):
        mixed = _signed(a + k * b)
        place = abs(mixed) % width  # the sign of a remainder is that of what is divided
        counts.append(struct.unpack_from(">q", sketch, 20 + 8 * depth + 8 * (k * width + place))[0])
    return min(counts)


def count_min_count(sketch: Column, value: str | None) -> Column:
    @F.pandas_udf("long")
    def read(sketches: pd.Series) -> pd.Series:
        return sketches.map(lambda s: count_min_estimate(s, value), na_action="ignore").astype("Int64")

    return read(sketch)
