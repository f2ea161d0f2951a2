"""Agglomeration graph: label bit fields, roots and leaves over (child, parent, layer) edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelSpec:
    """Bits of layer, x, y and z from the top; the segment has what is left of 64."""

    layer: int = 8
    spatial: int = 10

    @property
    def segment(self) -> int:
        return 64 - self.layer - 3 * self.spatial

    def fields(self) -> dict[str, tuple[int, int]]:
        """Name to (shift, bits)."""
        s, g = self.spatial, self.segment
        return {"layer": (g + 3 * s, self.layer), "x": (g + 2 * s, s), "y": (g + s, s), "z": (g, s), "segid": (0, g)}


def decode(label: Column, spec: LabelSpec = LabelSpec()) -> dict[str, Column]:
    return {k: F.shiftrightunsigned(label, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for k, (shift, bits) in spec.fields().items()}


def encode(fields: dict[str, Column], spec: LabelSpec = LabelSpec()) -> Column:
    """A label of its fields; a value that doesn't fit is an error."""
    out, beyond = F.lit(0).cast("long"), F.lit(False)
    for k, (shift, bits) in spec.fields().items():
        out = out.bitwiseOR(F.shiftleft(fields[k].cast("long"), shift))
        beyond = beyond | (fields[k] < 0) | (F.shiftrightunsigned(fields[k].cast("long"), bits) != 0)
    return F.when(beyond, F.raise_error(F.lit("a field doesn't fit its bits")).cast("long")).otherwise(out)


def roots(edges: DataFrame, ids: DataFrame, layers: int, stop_layer: int | None = None, at: int | None = None) -> DataFrame:
    """(id, root) by one join for each layer; an id without a parent is its own root, and 0's root is 0.

    With `at`, edges have valid_from, and a child's parent is the latest that was valid by then.
    """
    if at is not None:
        known = edges.where(F.col("valid_from") <= at)
        edges = known.groupBy("layer", "child").agg(F.max_by("parent", "valid_from").alias("parent"))
    out = ids.select(F.col("id"), F.col("id").alias("root"))
    for layer in range(1, (stop_layer or layers + 1)):
        step = edges.where(F.col("layer") == layer).select(F.col("child"), F.col("parent"))
        out = out.join(step, out["root"] == step["child"], "left").select("id", F.coalesce("parent", "root").alias("root"))
    return out.withColumn("root", F.when(F.col("id") == 0, F.col("id")).otherwise(F.col("root")))


def leaves(edges: DataFrame, roots_: DataFrame, layers: int, stop_layer: int = 1, box: tuple | None = None, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """(root, leaf): the descendants in the lowest layer, or in stop_layer.

    With a box ((x0, y0, z0), (x1, y1, z1)) of chunk positions, half open, only leaves whose label is of a chunk in it.
    """
    out = roots_.select(F.col("root"), F.col("root").alias("leaf"))
    for layer in range(layers, stop_layer - 1, -1):
        step = edges.where(F.col("layer") == layer).select("child", "parent")
        out = out.join(step, out["leaf"] == step["parent"]).select("root", F.col("child").alias("leaf"))
    if box is not None:
        at = decode(F.col("leaf"), spec)
        for a, lo, hi in zip("xyz", *box, strict=True):
            out = out.where((at[a] >= lo) & (at[a] < hi))
    return out


def chunk_position(point: dict[str, Column], chunk: tuple[int, int, int], offset: tuple[int, int, int] = (0, 0, 0), scale: tuple[float, float, float] = (1, 1, 1)) -> dict[str, Column]:
    """The chunk that a point is in; the point is scaled to the base resolution first."""
    from voxlake.functions.geometry import floor_div

    return {a: floor_div(F.floor(point[a] * F.lit(float(s))).cast("long") - o, c) for a, c, o, s in zip("xyz", chunk, offset, scale, strict=True)}


def chunk_box(position: dict[str, Column], chunk: tuple[int, int, int], offset: tuple[int, int, int] = (0, 0, 0), layer: int = 2, fan_out: int = 2) -> list[Column]:
    """The box x0, y0, z0, x1, y1, z1 of a chunk; a layer's chunks are fan_out times as wide as those below it, from layer 2 on."""
    wide = [c * fan_out ** max(0, layer - 2) for c in chunk]
    low = [position[a] * w + o for a, w, o in zip("xyz", wide, offset, strict=True)]
    return [*low, *[c + w for c, w in zip(low, wide, strict=True)]]


def segments(v: DataFrame, edges: DataFrame, chosen: DataFrame, layers: int, preserve_zeros: bool = False, top: int = (1 << 32) - 1) -> DataFrame:
    """Voxels of the leaves of chosen segments (ordinal, id), labelled by segment; a leaf of several goes to the last of them.

    Other labels become background, or top if the background is to stay apart from them.
    """
    from voxlake.operators.voxels import KEY, sized

    own = leaves(edges, chosen.select(F.col("id").alias("root")).distinct(), layers)
    named = own.join(chosen, own["root"] == chosen["id"]).groupBy("leaf").agg(F.max_by("id", "ordinal").alias("segment"))
    joined = v.join(sized(named), v["label"] == named["leaf"], "left" if preserve_zeros else "inner")
    return joined.select(*KEY, F.coalesce("segment", F.lit(top).cast("long")).alias("label"))


def chunk_mappings(edges: DataFrame) -> DataFrame:
    """(parent, children) of the lowest layer."""
    return edges.where("layer = 1").groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))
