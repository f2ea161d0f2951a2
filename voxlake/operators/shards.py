"""Shard locations, minishard indices and byte ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def location(key: Column, preshift: int, minishard_bits: int, shard_bits: int) -> tuple[Column, Column, Column]:
    """(shard number, shard name in hex, minishard) of a key under the identity hash."""
    h = F.shiftrightunsigned(key, preshift)
    minishard = h.bitwiseAND(F.lit((1 << minishard_bits) - 1).cast("long"))
    shard = F.shiftrightunsigned(h, minishard_bits).bitwiseAND(F.lit((1 << shard_bits) - 1).cast("long"))
    return shard, F.lpad(F.lower(F.hex(shard)), max(1, -(-shard_bits // 4)), "0"), minishard


def minishard_index(items: DataFrame, by: str, key: str, size: str) -> DataFrame:
    """Items with `start`, the bytes of the earlier ones of their group, and the deltas that an index stores."""
    order = W.partitionBy(by).orderBy(key)
    start = F.sum(size).over(order) - F.col(size)
    delta = F.col(key) - F.coalesce(F.lag(key).over(order), F.lit(0))
    return items.withColumn("start", start.cast("long")).withColumn("key_delta", delta.cast("long"))


def coalesced_ranges(ranges: DataFrame, path: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """(path, start, end, n): runs of ranges that touch or are at most gap bytes apart."""
    order = W.partitionBy(path).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(F.col(start) <= before + gap, 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(path, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__run")


def hashed_parameters(labels: int, max_shards: int = 16, max_per_minishard: int = 1024) -> tuple[int, int]:
    """(shard bits, minishard bits) for keys that are spread evenly."""
    shard_bits = max(0, min(math.ceil(math.log2(max_shards)), math.ceil(math.log2(max(1, labels / max_per_minishard)))))
    minishard_bits = max(0, math.ceil(math.log2(max(1, labels / (max_per_minishard * (1 << shard_bits))))))
    return shard_bits, minishard_bits


def hashed_columns(labels: Column, max_shards: int = 16, max_per_minishard: int = 1024) -> tuple[Column, Column]:
    up = lambda c: F.ceil(F.log2(F.greatest(c, F.lit(1.0)))).cast("long")
    n = labels.cast("double")
    shard = F.least(F.lit(math.ceil(math.log2(max_shards))).cast("long"), up(n / max_per_minishard))
    return shard, up(n / (max_per_minishard * F.pow(F.lit(2.0), shard)))


def image_parameters(grid: tuple[int, int, int], minishard_index_bytes: int = 40_000, shard_index_bytes: int = 8_192) -> tuple[int, int, int]:
    """(preshift bits, minishard bits, shard bits) for the chunks of a grid, numbered by morton code.

    Neighbouring chunks share a minishard while its index, of 24 bytes a chunk, fits; minishards a shard while
    the shard's index, of 16 bytes each, does; what bits are left tell shards apart.
    """
    left = sum((n - 1).bit_length() for n in grid)
    preshift = min(left, int(math.log2(max(1, minishard_index_bytes // 24))))
    minishard = min(left - preshift, int(math.log2(max(1, shard_index_bytes // 16))))
    return preshift, minishard, left - preshift - minishard


def shard_shape(grid: tuple[int, int, int], bits: int) -> tuple[int, ...]:
    """Chunks on each axis of the box that 2**bits consecutive morton codes fill: x gets a bit first, then y and z."""
    shape, i = [1, 1, 1], 0
    while bits and any((1 << i) < n for n in grid):
        for axis, n in enumerate(grid):
            if bits and (1 << i) < n:
                shape[axis] *= 2
                bits -= 1
        i += 1
    return tuple(shape)
