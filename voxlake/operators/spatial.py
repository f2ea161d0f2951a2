"""Spatial index: (cell, label, box) rows, as kept beside meshes and skeletons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.geometry import intersects

BOX = ["x0", "y0", "z0", "x1", "y1", "z1"]


def query(index: DataFrame, box: Sequence[int], cell: int) -> DataFrame:
    """Distinct labels with a box in the index that meets the given one; only the cells that it touches are read."""
    touched = index
    for c, lo, hi in zip(("cx", "cy", "cz"), box[:3], box[3:], strict=True):
        touched = touched.where(F.col(c).between(lo // cell, (hi - 1) // cell))
    return touched.where(intersects([F.col(c) for c in BOX], [F.lit(b) for b in box])).select("label").distinct()


def label_box(index: DataFrame) -> DataFrame:
    """Each label's box over all cells."""
    return index.groupBy("label").agg(*[F.min(c).alias(c) for c in BOX[:3]], *[F.max(c).alias(c) for c in BOX[3:]])


def label_files(index: DataFrame) -> DataFrame:
    """(label, n_files, files), a file being a cell's name."""
    name = F.concat_ws("_", *[F.col(c).cast("string") for c in ("cx", "cy", "cz")])
    return index.groupBy("label").agg(F.countDistinct(name).alias("n_files"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("files"))


def gaps(grid: DataFrame, index: DataFrame) -> DataFrame:
    """Cells of the grid that the index lacks."""
    return grid.join(index.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_anti")


def from_json(files: DataFrame) -> DataFrame:
    """(name, label, box) of files (name, content), whose content is JSON {label: [x0, y0, z0, x1, y1, z1]}."""
    parsed = files.select("name", F.explode(F.from_json("content", "map<string,array<bigint>>")).alias("label", "b"))
    return parsed.select("name", F.col("label").cast("long").alias("label"), *[F.col("b")[k].alias(c) for k, c in enumerate(BOX)])


def from_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The least half-open box around the points, one for each value of `by`."""
    edges = [F.min(a).alias(f"{a}0") for a in "xyz"] + [(F.max(a) + 1).alias(f"{a}1") for a in "xyz"]
    return points.groupBy(*by).agg(*edges)


def tables(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, boxes): cells with ids in the order of their corners, and a row for each label's box in a cell, as a database keeps the index."""
    from voxlake.operators.components import numbered

    cells = numbered(index.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "file_id")
    files = cells.select("file_id", F.concat_ws("_", "cx", "cy", "cz").alias("filename"))
    return files, index.join(cells, ["cx", "cy", "cz"]).select("file_id", "label", *BOX)
