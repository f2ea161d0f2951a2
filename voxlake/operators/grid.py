"""Chunk grids: the chunks of a box, their names and which of them exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.geometry import chunk_name, floor_div


def chunks(spark: SparkSession, low: Sequence[int], high: Sequence[int], size: Sequence[int], offset: Sequence[int] = (0, 0, 0), bounds: Sequence[int] | None = None) -> DataFrame:
    """(gx, gy, gz, x0, x1, y0, y1, z0, z1) of the grid's chunks that meet the box, clipped to bounds' high corner."""
    first = [(lo - o) // n for lo, n, o in zip(low, size, offset, strict=True)]
    count = [max(0, -((o - hi) // n) - f) for hi, n, o, f in zip(high, size, offset, first, strict=True)]
    out, rest = spark.range(count[0] * count[1] * count[2]), F.col("id")
    for a, f, m in zip("xyz", first, count, strict=True):
        out = out.withColumn(f"g{a}", F.pmod(rest, F.lit(max(m, 1)).cast("long")) + f)
        rest = floor_div(rest, max(m, 1))
    out = out.drop("id")
    for k, (a, n, o) in enumerate(zip("xyz", size, offset, strict=True)):
        end = (F.col(f"g{a}") + 1) * n + o
        out = out.withColumn(f"{a}0", F.col(f"g{a}") * n + o).withColumn(f"{a}1", F.least(end, F.lit(bounds[k]).cast("long")) if bounds else end)
    return out


def named(c: DataFrame) -> DataFrame:
    return c.withColumn("name", chunk_name([F.col(n) for n in ("x0", "x1", "y0", "y1", "z0", "z1")]))


def exists(c: DataFrame, v: DataFrame, size: Sequence[int]) -> DataFrame:
    """Chunks with whether the volume has a voxel in them."""
    held = v.select(*[floor_div(F.col(a), n).alias(f"g{a}") for a, n in zip("xyz", size, strict=True)]).distinct().withColumn("held", F.lit(True))
    return c.join(held, ["gx", "gy", "gz"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def shell(c: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """Chunks that are only partly in the box: all less the core."""
    core = c
    for a, lo, hi in zip("xyz", low, high, strict=True):
        core = core.where((F.col(f"{a}0") >= lo) & (F.col(f"{a}1") <= hi))
    return c.join(core.select("gx", "gy", "gz"), ["gx", "gy", "gz"], "left_anti")
