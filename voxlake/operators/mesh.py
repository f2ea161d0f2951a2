"""Meshes as (vid, x, y, z) and (v0, v1, v2), skeletons as vertices and edges."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlake.operators.components import connected_components, numbered

CORNERS = ["v0", "v1", "v2"]


def edges(faces: DataFrame) -> DataFrame:
    """Three unordered edges a face, repeats kept."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return faces.select(F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v0", "v2"))).alias("e")).select("e.a", "e.b")


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates."""
    out = faces
    for c in CORNERS:
        out = out.join(vertices.select(F.col("vid").alias(c), *[F.col(a).alias(f"{a}{c[1]}") for a in "xyz"]), c)
    return out.select(*CORNERS, *[f"{a}{k}" for k in range(3) for a in "xyz"])


def renamed(faces: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct faces with corners replaced by names (vid, new)."""
    out = faces
    for c in CORNERS:
        out = out.join(names.select(F.col("vid").alias(c), F.col("new").alias(f"n{c}")), c)
    return out.select(*[F.col(f"n{c}").alias(c) for c in CORNERS]).distinct()


def consolidate(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices without repeats, numbered by (x, y, z), and faces over them, without repeats."""
    places = numbered(vertices.select("x", "y", "z").distinct(), ["x", "y", "z"], "new")
    names = vertices.join(places, ["x", "y", "z"]).select("vid", "new")
    return places.select(F.col("new").alias("vid"), "x", "y", "z"), renamed(faces, names)


def dedupe_boundary(vertices: DataFrame, chunk: int) -> DataFrame:
    """(vid, new): vertices of which there are exactly two copies, on a chunk's border, are one; others stay."""
    border = F.lit(False)
    for a in "xyz":
        border = border | (F.pmod(F.col(a), F.lit(chunk)) == 0)
    place = W.partitionBy("x", "y", "z")
    merged = (F.count("*").over(place) == 2) & border
    return vertices.select("vid", F.when(merged, F.min("vid").over(place)).otherwise(F.col("vid")).alias("new"))


def crop(vertices: DataFrame, faces: DataFrame, low: Sequence[int], high: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Vertices in the closed box, and the faces all of whose corners are."""
    inside = vertices
    for a, lo, hi in zip("xyz", low, high, strict=True):
        inside = inside.where(F.col(a).between(lo, hi))
    kept = faces
    for c in CORNERS:
        kept = kept.join(inside.select(F.col("vid").alias(c)), c, "left_semi")
    return inside, kept.select(*CORNERS)


def cropped(vertices: DataFrame, faces: DataFrame, low: Sequence[int], high: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """As crop, with vertices numbered from 0 in the order of their old numbers."""
    inside, kept = crop(vertices, faces, low, high)
    names = numbered(inside.select("vid"), ["vid"], "new")
    out = kept
    for c in CORNERS:
        out = out.join(names.select(F.col("vid").alias(c), F.col("new").alias(f"n{c}")), c)
    return inside.join(names, "vid").select(F.col("new").alias("vid"), "x", "y", "z"), out.select(*[F.col(f"n{c}").alias(c) for c in CORNERS])


def dequantized(vertices: DataFrame, low: Sequence[float], size: Sequence[float], bits: int) -> DataFrame:
    """Coordinates from a grid of 2**bits - 1 steps over the fragment."""
    top = (1 << bits) - 1
    return vertices.select("vid", *[(F.col(a).cast("double") / top * float(s) + float(lo)).alias(a) for a, lo, s in zip("xyz", low, size, strict=True)])


def fragments(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, fragment) of the wanted labels, from manifests (label, fragments)."""
    return manifest.join(wanted.select("label").distinct(), "label").select("label", F.explode("fragments").alias("fragment"))


def box_of(vertices: DataFrame) -> DataFrame:
    return vertices.agg(*[F.min(a).alias(f"{a}0") for a in "xyz"], *[F.max(a).alias(f"{a}1") for a in "xyz"])


def concatenated(meshes: DataFrame) -> DataFrame:
    """Vertices of several meshes (mesh, vid, ...) numbered on: `new` is vid plus the vertices of earlier meshes."""
    sizes = meshes.groupBy("mesh").agg(F.count("*").alias("n"))
    starts = sizes.select("mesh", (F.sum("n").over(W.orderBy("mesh")) - F.col("n")).alias("start"))
    return meshes.join(starts, "mesh").withColumn("new", F.col("start") + F.col("vid")).drop("start")


def quantized(vertices: DataFrame, low: Sequence[float], size: Sequence[float], bits: int) -> DataFrame:
    """Coordinates on a grid of 2**bits - 1 steps over the fragment, clamped to it."""
    top = (1 << bits) - 1
    step = lambda a, lo, s: F.greatest(F.least(F.rint((F.col(a).cast("double") - lo) / s * top), F.lit(float(top))), F.lit(0.0)).cast("long")
    return vertices.select("vid", *[step(a, float(lo), float(s)).alias(a) for a, lo, s in zip("xyz", low, size, strict=True)])


def transformed(vertices: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Vertices by a 3 x 4 affine transform."""
    return vertices.select("vid", *[sum((F.col(b) * m for b, m in zip("xyz", row[:3], strict=True)), F.lit(float(row[3]))).alias(a) for a, row in zip("xyz", matrix, strict=True)])


def cable_length(vertices: DataFrame, edges_: DataFrame) -> DataFrame:
    """Sum of the lengths of distinct edges (a, b)."""
    e = edges_.distinct()
    for c in ("a", "b"):
        e = e.join(vertices.select(F.col("vid").alias(c), *[F.col(x).alias(f"{c}{x}") for x in "xyz"]), c)
    square = sum(((F.col(f"a{x}") - F.col(f"b{x}")) * (F.col(f"a{x}") - F.col(f"b{x}")) for x in "xyz"), F.lit(0))
    return e.agg(F.sum(F.sqrt(square.cast("double"))).alias("length"), F.count("*").alias("n_edges"))


def skeleton_components(vertices: DataFrame, edges_: DataFrame) -> DataFrame:
    """(vid, component), a vertex without edges being a component of its own."""
    every = edges_.select("a", "b").union(vertices.select(F.col("vid").alias("a"), F.col("vid").alias("b")))
    return connected_components(every, "a", "b").select(F.col("node").alias("vid"), "component")


def unordered(edges_: DataFrame) -> DataFrame:
    """Edges (a, b) with a < b, each once, without loops."""
    return edges_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def consolidated_skeleton(vertices: DataFrame, edges_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices without repeats, numbered by (x, y, z), and edges over them, without repeats and loops."""
    places = numbered(vertices.select("x", "y", "z").distinct(), ["x", "y", "z"], "new")
    names = vertices.join(places, ["x", "y", "z"]).select("vid", "new")
    out = edges_
    for c in ("a", "b"):
        out = out.join(names.select(F.col("vid").alias(c), F.col("new").alias(f"n{c}")), c)
    return places.select(F.col("new").alias("vid"), "x", "y", "z"), unordered(out.select(F.col("na").alias("a"), F.col("nb").alias("b")))


def connected_vertices(vertices: DataFrame, edges_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The skeleton without vertices that no edge has, numbered anew from 0 in their old order."""
    used = edges_.select(F.col("a").alias("vid")).union(edges_.select("b")).distinct()
    names = numbered(vertices.select("vid").join(used, "vid", "left_semi"), ["vid"], "new")
    out = edges_
    for c in ("a", "b"):
        out = out.join(names.select(F.col("vid").alias(c), F.col("new").alias(f"n{c}")), c)
    return vertices.join(names, "vid").select(F.col("new").alias("vid"), "x", "y", "z"), out.select(F.col("na").alias("a"), F.col("nb").alias("b"))


def merged_skeletons(skeletons: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several skeletons as one: their vertices and edges together, consolidated."""
    vertices = edges_ = None
    for k, (v, e) in enumerate(skeletons):
        own = lambda c, k=k: F.struct(F.lit(k).alias("s"), F.col(c).alias("v"))
        v, e = v.select(own("vid").alias("vid"), "x", "y", "z"), e.select(own("a").alias("a"), own("b").alias("b"))
        vertices, edges_ = (v, e) if vertices is None else (vertices.union(v), edges_.union(e))
    return consolidated_skeleton(vertices, edges_)


def equivalent(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> bool:
    """Whether two skeletons have the same vertices by place and the same edges between places."""
    sides = []
    for v, e in (first, second):
        places, kept = consolidated_skeleton(v, e)
        sides.append((places, kept))
    return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in zip(*sides, strict=True))


def downsampled_skeleton(vertices: DataFrame, edges_: DataFrame, factor: int) -> tuple[DataFrame, DataFrame]:
    """Every factor-th vertex of each unbranched path stays, as do ends and branching points; numbered anew.

    A path, from the lesser of the vertices at its ends, is walked in one task.
    """
    if factor < 1:
        raise ValueError("the factor must be positive")
    e = unordered(edges_)
    both = e.union(e.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    inner = degree.where("n = 2").select("a")
    # the path of inner vertices that each is on, and its place along it from the end with the least vertex
    links = e.join(inner.select(F.col("a")), "a", "left_semi").join(inner.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    alone = inner.select("a", F.col("a").alias("b"))
    path = connected_components(links.union(alone), "a", "b")

    def places(table: pa.Table) -> pa.Table:
        around: dict[int, list[int]] = {}
        for x, y in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
            around.setdefault(x, []).append(y)
        # from the lesser of the two vertices outside of the path; a ring begins at its least vertex
        tips = [(y, x) for x, ys in around.items() for y in ys if y not in around]
        before, x = min(tips) if tips else (min(around), min(around[min(around)]))
        first, order = before, []
        while x in around and not (not tips and x == first):
            order.append(x)
            after = [y for y in around[x] if y != before]
            before, x = x, after[0] if after else before
        kept = [first, *order[factor - 1 :: factor], x]
        pairs = [(p, q) for p, q in zip(kept, kept[1:], strict=False) if p != q]
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    grouped = both.join(path.select(F.col("node").alias("a"), "component"), "a")
    short = grouped.groupBy("component").applyInArrow(places, "a long, b long")
    outside = e.join(inner.select("a"), "a", "left_anti").join(inner.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b")
    return connected_vertices(vertices, unordered(outside.union(short)))
