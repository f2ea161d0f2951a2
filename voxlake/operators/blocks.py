"""The block relation: (bx, by, bz, palette, bits, idx) of palette-compressed cubes of voxels.

A palette is sorted and includes 0 where a voxel of the block is absent; idx holds each voxel's place in it,
x fastest. A block of background alone is an absent row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.geometry import floor_div, in_box
from voxlake.operators.voxels import KEY, SMALL_ROWS

BLOCK = ["bx", "by", "bz"]


def block_columns(size: int) -> list[Column]:
    return [floor_div(F.col(a), size).alias(b) for a, b in zip(KEY, BLOCK, strict=True)]


def place_in_block(size: int) -> Column:
    x, y, z = (F.pmod(F.col(a), F.lit(size)) for a in KEY)
    return (x + size * (y + size * z)).cast("int")


def bits_for(n: Column) -> Column:
    """0 for one label, else the least of 1, 2, 4, 8, 16 and 32 whose power of two is n or more."""
    out = F.lit(32)
    for b in (16, 8, 4, 2, 1):
        out = F.when(n <= (1 << b), F.lit(b)).otherwise(out)
    return F.when(n == 1, F.lit(0)).otherwise(out)


def palettes(v: DataFrame, size: int = 8) -> DataFrame:
    """(bx, by, bz, palette, bits, n_voxels) of blocks with a voxel."""
    g = v.select("label", *block_columns(size)).groupBy(*BLOCK).agg(F.collect_set("label").alias("labels"), F.count("*").alias("n_voxels"))
    palette = F.array_sort(F.when(F.col("n_voxels") < size**3, F.array_union(F.array(F.lit(0).cast("long")), "labels")).otherwise(F.col("labels")))
    return g.select(*BLOCK, palette.alias("palette"), "n_voxels").withColumn("bits", bits_for(F.size("palette")).cast("long"))


def encode(v: DataFrame, size: int = 8) -> DataFrame:
    """Blocks with their palettes and indices."""
    rows = v.select("label", place_in_block(size).alias("place"), *block_columns(size))
    g = rows.groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("place", "label"))).alias("held"), F.collect_set("label").alias("labels"), F.count("*").alias("n"))
    palette = F.array_sort(F.when(F.col("n") < size**3, F.array_union(F.array(F.lit(0).cast("long")), "labels")).otherwise(F.col("labels")))
    g = g.select(*BLOCK, "held", palette.alias("palette"))
    idx = F.transform(F.sequence(F.lit(0), F.lit(size**3 - 1)), lambda k: (F.array_position("palette", F.coalesce(F.col("held")[k], F.lit(0).cast("long"))) - 1).cast("int"))
    return g.select(*BLOCK, "palette", bits_for(F.size("palette")).cast("long").alias("bits"), idx.alias("idx"))


def decode(b: DataFrame, size: int = 8) -> DataFrame:
    """The voxels of blocks, without background."""
    rows = b.select(*BLOCK, "palette", F.posexplode("idx").alias("place", "i")).select(*BLOCK, "place", F.element_at("palette", F.col("i") + 1).alias("label")).where("label <> 0")
    x, y, z = F.pmod(F.col("place"), F.lit(size)), F.pmod(F.floor(F.col("place") / size), F.lit(size)), F.floor(F.col("place") / (size * size))
    return rows.select(*[(F.col(c) * size + p).cast("long").alias(a) for c, p, a in zip(BLOCK, (x, y, z), KEY, strict=True)], "label")


def labels(b: DataFrame) -> DataFrame:
    """Distinct labels by palettes alone."""
    return b.select(F.explode("palette").alias("label")).distinct()


def prune(b: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Blocks whose palette has one of the labels."""
    return b.where(F.arrays_overlap("palette", F.array(*[F.lit(int(w)).cast("long") for w in wanted])))


def classify(b: DataFrame, label: int) -> DataFrame:
    """class 0 where no voxel has the label, 1 where all have it, 2 where some have."""
    has = F.array_contains("palette", F.lit(label).cast("long"))
    return b.select(*BLOCK, F.when(~has, 0).when(F.size("palette") == 1, 1).otherwise(2).cast("long").alias("class"))


def remap(b: DataFrame, mapping: DataFrame, strict: bool = False, rows: int = SMALL_ROWS) -> DataFrame:
    """Palettes remapped without decoding; mapping has (label, root) and leaves out what stays.

    Up to so many rows of it are sent to every executor as one map; beyond that the distinct palettes' labels are joined with it.
    """
    m = mapping.select("label", "root")
    lost = (lambda e: F.raise_error(F.concat(F.lit("no root for label "), e.cast("string"))).cast("long")) if strict else (lambda e: e)
    if m.limit(rows + 1).count() <= rows:
        one = m.agg(F.map_from_entries(F.collect_list(F.struct("label", "root"))).alias("__m"))
        return b.crossJoin(F.broadcast(one)).withColumn("palette", F.transform("palette", lambda e: F.when(e == 0, e).otherwise(F.coalesce(F.col("__m")[e], lost(e))))).drop("__m")
    each = b.select("palette").distinct().select("palette", F.posexplode("palette").alias("k", "label")).join(m, "label", "left")
    target = F.when(F.col("label") == 0, F.col("label")).otherwise(F.coalesce("root", lost(F.col("label"))))
    known = each.groupBy("palette").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", target.alias("to")))), lambda s: s["to"]).alias("__new"))
    return b.join(known, "palette").withColumn("palette", F.col("__new")).drop("__new").select(*b.columns)


def bitstream(b: DataFrame, label: int) -> DataFrame:
    """Blocks that have the label, recoded to one bit a voxel: idx is 1 where the label is and the palette is (0, label)."""
    place = (F.array_position("palette", F.lit(label).cast("long")) - 1).cast("int")
    recoded = F.transform("idx", lambda i: F.when(i == F.col("__place"), 1).otherwise(0).cast("int"))
    rows = prune(b, [label]).withColumn("__place", place)
    return rows.select(*BLOCK, F.array(F.lit(0).cast("long"), F.lit(label).cast("long")).alias("palette"), F.lit(1).cast("long").alias("bits"), recoded.alias("idx"))


def at(b: DataFrame, points: DataFrame, size: int = 8) -> DataFrame:
    """The label at each distinct point, read from its block's index."""
    p = points.select(*KEY).distinct().withColumn("place", place_in_block(size))
    p = p.select(*KEY, "place", *block_columns(size))
    return p.join(b, BLOCK, "left").select(*KEY, F.coalesce(F.element_at("palette", F.element_at("idx", F.col("place") + 1) + 1), F.lit(0)).cast("long").alias("label"))


def clip(v: DataFrame, low: Sequence[int], high: Sequence[int], size: int = 8) -> DataFrame:
    """Palettes of the blocks of a box, with what is outside it zeroed; blocks left empty are dropped."""
    return palettes(v.where(in_box(low, high)), size)


def interior(low: Sequence[int], high: Sequence[int], size: int = 8) -> Column:
    """Whether a whole block is inside the box: its palette answers without decoding."""
    out = F.lit(True)
    for b, lo, hi in zip(BLOCK, low, high, strict=True):
        out = out & (F.col(b) * size >= lo) & ((F.col(b) + 1) * size <= hi)
    return out


def unique(v: DataFrame, b: DataFrame, low: Sequence[int], high: Sequence[int], size: int = 8) -> DataFrame:
    """Distinct labels of a box: palettes of interior blocks, voxels of the shell."""
    shell = v.where(in_box(low, high)).select("label", *block_columns(size)).where(~interior(low, high, size)).select("label")
    return labels(b.where(interior(low, high, size))).where("label <> 0").union(shell).distinct()
