"""Operators on the voxel relation (x, y, z, label). Background is label 0, an absent row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.geometry import AXES, floor_div, in_box
from voxlake.operators.components import connected_components, cut, least_roots, numbered

KEY = list(AXES)
#: Half of the 26 neighbours of a voxel; the others are their opposites.
FORWARD = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
PLANE = [(1, 0), (-1, 0), (0, 1), (0, -1)]
SMALL_ROWS = 100_000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def box(v: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    return v.where(in_box(low, high))


def strided(v: DataFrame, low: Sequence[int], high: Sequence[int], step: Sequence[int]) -> DataFrame:
    """Every step-th voxel from the box's low corner; steps are positive."""
    if min(step) < 1:
        raise ValueError("steps must be positive")
    out = box(v, low, high)
    for a, lo, s in zip(KEY, low, step, strict=True):
        out = out.where(F.pmod(F.col(a) - lo, F.lit(s)) == 0)
    return out


def where_mask(v: DataFrame, label: int, hit: int = 255, miss: int = 0) -> DataFrame:
    """hit at voxels of the label, miss at other foreground."""
    return v.select(*KEY, F.when(F.col("label") == label, F.lit(hit)).otherwise(F.lit(miss)).cast("long").alias("label"))


def mask_except(v: DataFrame, labels: Sequence[int], preserve_zeros: bool = False, top: int = (1 << 32) - 1) -> DataFrame:
    """Other labels become background, or top if the background is to stay apart from them."""
    if not preserve_zeros:
        return v.where(F.col("label").isin(*labels))
    return v.withColumn("label", F.when(F.col("label").isin(*labels), F.col("label")).otherwise(F.lit(top).cast("long")))


def remap(v: DataFrame, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """Labels replaced by mapping's root; a label that it lacks stays, or is an error if strict."""
    joined = v.join(sized(mapping.select("label", "root")), "label", "left")
    lost = F.raise_error(F.concat(F.lit("no root for label "), F.col("label").cast("string"))) if strict else F.col("label")
    return joined.select(*KEY, F.coalesce("root", lost).cast("long").alias("label"))


def unique(v: DataFrame, volume: int | None = None) -> DataFrame:
    """Distinct labels; with the box's volume, 0 too if a voxel is absent."""
    found = v.select("label").distinct()
    if volume is None:
        return found
    return found.union(v.agg(F.count("*").alias("n")).where(F.col("n") < volume).select(F.lit(0).cast("long"))).distinct()


def with_background(found: DataFrame) -> DataFrame:
    """Distinct labels, and 0 once, also where every voxel has another label."""
    zero = found.sparkSession.range(0, 1, 1, 1).select(F.lit(0).cast("long").alias("label"))
    return found.where(~F.col("label").eqNullSafe(0)).union(zero)


def renumber(v: DataFrame) -> DataFrame:
    """Labels 1, 2, ... in the order of the old ones."""
    order = numbered(v.select("label").distinct(), ["label"], "new_label")
    return v.join(sized(order), "label").select(*KEY, (F.col("new_label") + 1).alias("label"))


def squared(center: Sequence, axes: Sequence[str] = AXES) -> Column:
    out = None
    for a, c in zip(axes, center, strict=True):
        d = F.col(a) - (c if isinstance(c, Column) else F.lit(int(c)))
        out = d * d if out is None else out + d * d
    return out


def tie_order(tie: str = "block", block: int = 8) -> list[Column]:
    """Which of several nearest voxels is first: in block order, or the least (x, y, z)."""
    if tie == "c":
        return [F.col(a) for a in KEY]
    back = [F.col(a) for a in reversed(KEY)]
    return [floor_div(c, block) for c in back] + [F.pmod(c, F.lit(block)) for c in back]


def nearest(v: DataFrame, center: Sequence[int], include_self: bool = False, tie: str = "block") -> DataFrame:
    """The foreground voxel that is nearest to center, with d2 and how many are as near; at most one row."""
    d = v.withColumn("d2", squared(center))
    if not include_self:
        d = d.where("d2 > 0")
    first = d.select(F.min_by(F.struct("*"), F.struct("d2", *tie_order(tie))).alias("s"), F.min("d2").alias("m")).where("s is not null")
    ties = d.groupBy("d2").agg(F.count("*").alias("n_nearest"))
    return first.join(ties, first.m == ties.d2).select("s.x", "s.y", "s.z", "s.label", "s.d2", "n_nearest")


def linear(v: DataFrame) -> Column:
    """One number for a voxel; a coordinate beyond 2**20 of 0 is an error."""
    shift = 1 << 20
    beyond = F.greatest(*[F.abs(F.col(a)) for a in KEY]) >= shift
    number = ((F.col("x") + shift) * (1 << 21) + F.col("y") + shift) * (1 << 21) + F.col("z") + shift
    return F.when(beyond, F.raise_error(F.lit("a coordinate is beyond 2**20")).cast("long")).otherwise(number)


def local_components(v: DataFrame, chunk: int) -> DataFrame:
    """(x, y, z, node, root): each voxel's number, and the least number in its 26-connected component within its chunk."""

    def own(table: pa.Table) -> pa.Table:
        xyz = np.stack([table.column(a).to_numpy() for a in KEY], axis=1)
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        root = np.empty(len(node), np.int64)
        # label_26 gives the least index, so rows in the order of their numbers give the least number
        root[order] = node[order][label_26(xyz[order])]
        return pa.table({a: table.column(a) for a in KEY} | {"node": table.column("node"), "root": root})

    rows = v.select(*KEY, linear(v).alias("node")).dropDuplicates(["node"])
    return rows.groupBy(*[floor_div(F.col(a), chunk) for a in KEY]).applyInArrow(own, "x long, y long, z long, node long, root long")


def components(v: DataFrame, chunk: int = 128) -> DataFrame:
    """Voxels with `component`, the least linear number in their 26-connected component of foreground.

    Components are found within chunks first, so that what goes through the rounds of contraction is an edge for each pair of
    chunk-wise components that touch, not the neighbours of each voxel. Only voxels on a chunk's faces are joined.
    """
    found = cut(local_components(v, chunk))
    on_face = F.lit(False)
    for a in KEY:
        on_face = on_face | F.pmod(F.col(a), F.lit(chunk)).isin(0, chunk - 1)
    faces = found.where(on_face).select(*KEY, "root")
    step = F.array(*[F.struct(*[F.lit(d).cast("long").alias(n) for n, d in zip("abc", o, strict=True)]) for o in FORWARD])
    reach = faces.select(*KEY, F.col("root").alias("src"), F.explode(step).alias("o")).select("src", *[F.col(n).alias(f"o{n}") for n in KEY], *[(F.col(n) + F.col(f"o.{d}")).alias(n) for n, d in zip(KEY, "abc", strict=True)])
    crosses = F.lit(False)
    for a in KEY:
        crosses = crosses | (floor_div(F.col(a), chunk) != floor_div(F.col(f"o{a}"), chunk))
    edges = reach.where(crosses).join(faces.withColumnRenamed("root", "dst"), KEY).select("src", "dst").where("src <> dst").distinct()
    joined = connected_components(edges)
    rooted = found.join(sized(joined), found.root == joined.node, "left").select(*[found[a] for a in KEY], F.coalesce(joined.component, found.root).alias("component"))
    return v.join(rooted, KEY)


def component_at(v: DataFrame, seed: DataFrame, rows: int = 4_000_000) -> DataFrame:
    """The voxels that are 26-connected with the voxel (x, y, z) of seed; none without a seed.

    Up to so many voxels, a box's, are one task's work; more are labelled chunk by chunk.
    """
    columns = v.columns
    first = seed.select(*[F.col(a).alias(f"s{a}") for a in KEY]).limit(1)
    if v.limit(rows + 1).count() > rows:
        labelled = cut(components(v))
        at = labelled.join(F.broadcast(first), [F.col(a) == F.col(f"s{a}") for a in KEY]).select(F.col("component").alias("chosen"))
        return labelled.join(F.broadcast(at), labelled.component == at.chosen).select(*v.columns)

    def own(table: pa.Table) -> pa.Table:
        at = np.stack([table.column(a).to_numpy() for a in KEY], axis=1)
        point = np.array([table.column(f"s{a}")[0].as_py() for a in KEY])
        hit = np.flatnonzero((at == point).all(axis=1))
        keep = np.zeros(len(at), bool)
        if len(hit):
            places, which = np.unique(at, axis=0, return_inverse=True)
            root = label_26(places)[which.ravel()]
            keep = root == root[hit[0]]
        return table.filter(pa.array(keep)).select(columns)

    together = v.select(*v.columns).crossJoin(F.broadcast(first))
    return together.groupBy("sx", "sy", "sz").applyInArrow(own, v.schema)


def boundary(v: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels that lack one of the four neighbours in their z slice."""
    by = [*keys, *KEY]
    shifts = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in PLANE])
    around = v.select(*by, F.explode(shifts).alias("s")).select(*keys, (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), "z").groupBy(*by).agg(F.count("*").alias("__around"))
    return v.join(around, by, "left").where(F.coalesce("__around", F.lit(0)) < 4).select(*v.columns)


#: The 8 neighbours in a slice, around a voxel in turn; those at even places share a side with it.
RING = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def contours(v: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Boundary voxels with `n`, how often the contours of their slice, outer ones and those of holes, pass through each.

    Contours follow 8-connected foreground point by point. One passes through a voxel for each gap in the ring of its
    neighbours, a gap being a run of background that has a side of the voxel in it. So the gaps are counted, as the sides
    that are free less those that a free corner joins to the next free side, and nothing has to be traced.
    """
    by = [*keys, *KEY]
    shifts = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(1 << ((k + 4) % 8)).alias("bit")) for k, (a, b) in enumerate(RING)])
    seen = v.select(*by, F.explode(shifts).alias("s")).select(*keys, (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), "z", "s.bit").groupBy(*by).agg(F.bit_or("bit").alias("__held"))
    free = lambda k: F.expr(f"int((coalesce(__held, 0) & {1 << (k % 8)}) = 0)")
    sides = free(0) + free(2) + free(4) + free(6)
    joined = sum((free(k) * free(k + 1) * free(k + 2) for k in (0, 2, 4, 6)), F.lit(0))
    n = F.when(F.coalesce("__held", F.lit(0)) == 0, F.lit(1)).otherwise(sides - joined).cast("long")
    return v.join(seen, by, "left").withColumn("n", n).where("n > 0").select(*v.columns, "n")


def overlay(old: DataFrame, new: DataFrame, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> DataFrame:
    """new painted over old, inside a box if one is given; a voxel of both has new's label."""
    painted = new if low is None else box(new, low, high)
    joined = old.select(*KEY, F.col("label").alias("old")).join(painted.select(*KEY, F.col("label").alias("new")), KEY, "full_outer")
    return joined.select(*KEY, F.coalesce("new", "old").alias("label"))


def replaced(old: DataFrame, new: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """A box written as a whole: what old has in it goes, absent voxels of new being background there."""
    return old.where(~in_box(low, high)).select(*KEY, "label").union(box(new, low, high).select(*KEY, "label"))


def points(v: DataFrame, at: DataFrame) -> DataFrame:
    """The label at each distinct point, 0 where there is none."""
    return at.select(*KEY).distinct().join(v, KEY, "left").select(*KEY, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def around(v: DataFrame, point: Sequence[int], size: Sequence[int]) -> DataFrame:
    """The box of the given size whose centre, rounded down, is the point."""
    low = [p - s // 2 for p, s in zip(point, size, strict=True)]
    return box(v, low, [a + s for a, s in zip(low, size, strict=True)])


def case_voxels(v: DataFrame, candidates: DataFrame, half: Sequence[int], chunk: int = 32) -> DataFrame:
    """(case_id, leg, cx, cy, cz, x, y, z) of the voxels of either segment around each candidate's point.

    The range join is an equality join on the chunks that a case's box touches, with the box as a residue.
    """
    legs = candidates.select("case_id", "cx", "cy", "cz", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("leg"), F.col("seg1").alias("seg")), F.struct(F.lit(1).cast("long").alias("leg"), F.col("seg2").alias("seg")))).alias("l")).select("*", "l.leg", "l.seg").drop("l")
    for a, h in zip(KEY, half, strict=True):
        legs = legs.withColumn(f"g{a}", F.explode(F.sequence(floor_div(F.col(f"c{a}") - h, chunk), floor_div(F.col(f"c{a}") + h - 1, chunk))))
    cells = v.select(*KEY, F.col("label").alias("seg"), *[floor_div(F.col(a), chunk).alias(f"g{a}") for a in KEY])
    joined = cells.join(sized(legs), ["gx", "gy", "gz", "seg"])
    for a, h in zip(KEY, half, strict=True):
        joined = joined.where((F.col(a) >= F.col(f"c{a}") - h) & (F.col(a) < F.col(f"c{a}") + h))
    return joined.select("case_id", "leg", "cx", "cy", "cz", *KEY)


def label_26(xyz: np.ndarray) -> np.ndarray:
    """Component numbers of distinct int voxels [n, 3], by pointer jumping over sorted keys."""
    n = len(xyz)
    low = xyz.min(axis=0) - 1
    span = xyz.max(axis=0) - low + 2
    key = ((xyz[:, 0] - low[0]) * span[1] + xyz[:, 1] - low[1]) * span[2] + xyz[:, 2] - low[2]
    order = np.argsort(key)
    ordered = key[order]
    src, dst = [], []
    for a, b, c in FORWARD:
        want = key + (a * span[1] + b) * span[2] + c
        at = np.minimum(np.searchsorted(ordered, want), n - 1)
        hit = ordered[at] == want
        src.append(np.flatnonzero(hit))
        dst.append(order[at[hit]])
    return least_roots(np.concatenate(src), np.concatenate(dst), n)


def free_sides(xyz: np.ndarray) -> np.ndarray:
    """Whether each of distinct int voxels [n, 3] lacks one of the four neighbours in its z slice."""
    low = xyz.min(axis=0) - 1
    span = xyz.max(axis=0) - low + 2
    key = ((xyz[:, 2] - low[2]) * span[0] + xyz[:, 0] - low[0]) * span[1] + xyz[:, 1] - low[1]
    ordered = np.sort(key)
    free = np.zeros(len(key), bool)
    for a, b in PLANE:
        want = key + a * span[1] + b
        free |= ordered[np.minimum(np.searchsorted(ordered, want), len(key) - 1)] != want
    return free


def pairwise_clouds(v: DataFrame, candidates: DataFrame, half: Sequence[int] = (80, 80, 32), resolution: Sequence[int] = (4, 4, 40), block: int = 8) -> DataFrame:
    """(case_id, x, y, z, label): boundary points of each candidate pair, in nanometres.

    A leg keeps the 26-connected component, within its box, of the voxel nearest to the point, and of
    that the voxels with a free side in their slice. A box is bounded, so a leg is worked out in one task.
    """

    def leg(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        xyz, center = np.stack([get(a) for a in KEY], axis=1), np.array([get(f"c{a}")[0] for a in KEY])
        d2 = ((xyz - center) ** 2).sum(axis=1)
        order = np.lexsort((*(xyz % block).T, *(xyz // block).T, d2))
        order = order[d2[order] > 0]
        out = np.zeros((0, 3), np.int64)
        if len(order):
            root = label_26(xyz)
            own = xyz[root == root[order[0]]]
            out = own[free_sides(own)] * np.array(resolution)
        n = len(out)
        return pa.table({"case_id": np.full(n, get("case_id")[0]), "x": out[:, 0], "y": out[:, 1], "z": out[:, 2], "label": np.full(n, get("leg")[0])})

    legs = case_voxels(v, candidates, half)
    return legs.groupBy("case_id", "leg").applyInArrow(leg, "case_id long, x long, y long, z long, label long")
