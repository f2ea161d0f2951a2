"""The library's front: volumes, meshes and spatial indices with their operators as methods."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.geometry import floor_div, morton
from voxlake.operators import blocks, graph, mesh, shards, spatial, voxels
from voxlake.operators.components import cut
from voxlake.sources import formats
from voxlake.sources.formats import register_format
from voxlake.sources.volume import from_numpy, read_blocks, read_voxel, read_volume, transfer, write_volume, write_zarr

pairwise_clouds = voxels.pairwise_clouds
shard_location = shards.location
encode_label, decode_label = graph.encode, graph.decode
roots, leaves = graph.roots, graph.leaves
__all__ = [
    "Mesh", "SpatialIndex", "Volume", "decode_label", "encode_label", "from_numpy", "leaves", "morton", "open_volume", "pairwise_clouds", "read_blocks", "read_voxel", "register_format", "roots", "shard_location", "transfer", "write_zarr",
]


@dataclass(frozen=True)
class Volume:
    """A lazy voxel relation (x, y, z, label) and the scale it was read at, if any."""

    df: DataFrame
    scale: formats.Scale | None = None

    def _new(self, df: DataFrame) -> Volume:
        return replace(self, df=df)

    def box(self, low: Sequence[int], high: Sequence[int], step: Sequence[int] = (1, 1, 1)) -> Volume:
        return self._new(voxels.box(self.df, low, high) if tuple(step) == (1, 1, 1) else voxels.strided(self.df, low, high, step))

    def slices(self, given: slice | int | tuple, bounded: bool = True) -> tuple[list[int], list[int], list[int]]:
        """Corners and steps of vol[x0:x1:sx, y, ...]: a number is one voxel, an ellipsis or a missing axis is all of it.

        Open ends need a scale. With one, a box beyond the volume is an error if bounded, else it is cut off.
        """
        given = list(given) if isinstance(given, tuple) else [given]
        if given.count(Ellipsis) > 1 or len(given) - given.count(Ellipsis) > 3:
            raise IndexError("too many axes")
        at = given.index(Ellipsis) if Ellipsis in given else len(given)
        given = given[:at] + [slice(None)] * (3 - len(given) + (Ellipsis in given)) + given[at + 1 :]
        low, high, step = [], [], []
        for k, s in enumerate(given):
            s = slice(s, s + 1) if isinstance(s, int) else s
            if s.step is not None and s.step < 1:
                raise ValueError("steps must be positive")
            if (s.start is None or s.stop is None) and self.scale is None:
                raise ValueError("the volume's bounds aren't known")
            low.append(self.scale.offset[k] if s.start is None else s.start)
            high.append(self.scale.end[k] if s.stop is None else s.stop)
            step.append(s.step or 1)
        if self.scale is not None:
            if bounded and any(a < o or b > e or a > b for a, b, o, e in zip(low, high, self.scale.offset, self.scale.end, strict=True)):
                raise formats.OutOfBounds(f"{tuple(low)} - {tuple(high)} isn't in {self.scale.offset} - {self.scale.end}")
            low, high = [max(a, o) for a, o in zip(low, self.scale.offset, strict=True)], [min(b, e) for b, e in zip(high, self.scale.end, strict=True)]
        return low, high, step

    def __getitem__(self, given: slice | int | tuple) -> Volume:
        return self.box(*self.slices(given))

    def cutout(self, low: Sequence[int], high: Sequence[int]) -> Volume:
        """A box, cut from its lineage, with a scale of its own: a volume that is read many times."""
        own = None if self.scale is None else replace(self.scale, offset=tuple(low), size=tuple(b - a for a, b in zip(low, high, strict=True)), sharding=None)
        return Volume(cut(voxels.box(self.df, low, high)), own)

    def contours(self) -> DataFrame:
        return voxels.contours(self.df)

    def where(self, label: int) -> Volume:
        return self._new(self.df.where(F.col("label") == label))

    def mask_except(self, labels: Sequence[int], preserve_zeros: bool = False) -> Volume:
        return self._new(voxels.mask_except(self.df, labels, preserve_zeros))

    def remap(self, mapping: DataFrame, strict: bool = False) -> Volume:
        return self._new(voxels.remap(self.df, mapping, strict))

    def agglomerate(self, edges: DataFrame, layers: int, stop_layer: int | None = None, at: int | None = None) -> Volume:
        """Labels replaced by their roots."""
        ids = self.df.select(F.col("label").alias("id")).distinct()
        return self.remap(graph.roots(edges, ids, layers, stop_layer, at).select(F.col("id").alias("label"), "root"))

    def unique(self) -> DataFrame:
        return voxels.unique(self.df)

    def renumber(self) -> Volume:
        return self._new(voxels.renumber(self.df))

    def points(self, at: DataFrame) -> DataFrame:
        return voxels.points(self.df, at)

    def nearest(self, center: Sequence[int], include_self: bool = False, tie: str = "block") -> DataFrame:
        return voxels.nearest(self.df, center, include_self, tie)

    def component(self, seed: DataFrame) -> Volume:
        return self._new(voxels.component_at(self.df, seed))

    def components(self) -> DataFrame:
        return voxels.components(self.df)

    def boundary(self) -> Volume:
        return self._new(voxels.boundary(self.df))

    def cloud(self, scale: Sequence[float] | None = None) -> DataFrame:
        """Boundary points in physical units."""
        r = scale or (self.scale.resolution if self.scale else (1, 1, 1))
        return self.boundary().df.select(*[(F.col(a) * F.lit(float(n))).cast("float").alias(a) for a, n in zip("xyz", r, strict=True)], "label")

    def blocks(self, size: int = 8) -> DataFrame:
        return blocks.encode(self.df, size)

    def downsample(self, factor: Sequence[int]) -> Volume:
        """The most frequent label of each cell, background left out, the least of those as frequent."""
        cell = [floor_div(F.col(a), n).alias(a) for a, n in zip("xyz", factor, strict=True)]
        counts = self.df.select(*cell, "label").groupBy("x", "y", "z", "label").agg(F.count("*").alias("n"))
        return Volume(counts.groupBy("x", "y", "z").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")), None if self.scale is None else formats.add_scale([self.scale], factor))

    def overlay(self, new: Volume, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> Volume:
        return self._new(voxels.overlay(self.df, new.df, low, high))

    def write(self, path: str, scale: formats.Scale | None = None, low: Sequence[int] | None = None, high: Sequence[int] | None = None, **options) -> DataFrame:
        return write_volume(self.df, path, scale or self.scale, low=low, high=high, **options)


def open_volume(spark: SparkSession, path: str, mip: int = 0, **options) -> Volume:
    return Volume(read_volume(spark, path, mip, **options), formats.open_volume(path, mip).scale)


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    faces: DataFrame

    def edges(self) -> DataFrame:
        return mesh.edges(self.faces)

    def triangles(self) -> DataFrame:
        return mesh.triangles(self.vertices, self.faces)

    def consolidate(self) -> Mesh:
        return Mesh(*mesh.consolidate(self.vertices, self.faces))

    def dedupe_boundary(self, chunk: int) -> Mesh:
        names = mesh.dedupe_boundary(self.vertices, chunk)
        return Mesh(self.vertices.join(names.select(F.col("new").alias("vid")).distinct(), "vid"), mesh.renamed(self.faces, names))

    def crop(self, low: Sequence[int], high: Sequence[int]) -> Mesh:
        return Mesh(*mesh.crop(self.vertices, self.faces, low, high))

    def transform(self, matrix: Sequence[Sequence[float]]) -> Mesh:
        return Mesh(mesh.transformed(self.vertices, matrix), self.faces)

    @staticmethod
    def concat(meshes: DataFrame) -> DataFrame:
        return mesh.concatenated(meshes)


@dataclass(frozen=True)
class SpatialIndex:
    index: DataFrame
    cell: int

    def query(self, box: Sequence[int]) -> DataFrame:
        return spatial.query(self.index, box, self.cell)

    def label_bbox(self) -> DataFrame:
        return spatial.label_box(self.index)

    def files(self) -> DataFrame:
        return spatial.label_files(self.index)
