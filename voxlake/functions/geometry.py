"""Boxes, units, scales and grids as Column expressions. Boxes are half-open, [low, high), unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Triple = Sequence[int]

#: Metres in a spatial unit.
SPACE_UNITS = {unit: 10.0**power for unit, power in zip("pm A nm um mm cm m km Mm Gm Tm".split(), (-12, -10, -9, -6, -3, -2, 0, 3, 6, 9, 12), strict=True)}
#: Seconds in a unit of time.
TIME_UNITS = dict(zip("ns us ms s min h d".split(), (1e-9, 1e-6, 1e-3, 1.0, 60.0, 3600.0, 86400.0), strict=True))


def in_box(low: Triple, high: Triple, axes: Sequence[str] = AXES) -> Column:
    """Whether a voxel is in the box; simple comparisons, so that scans can prune by them."""
    out = F.lit(True)
    for a, lo, hi in zip(axes, low, high, strict=True):
        out = out & (F.col(a) >= F.lit(lo)) & (F.col(a) < F.lit(hi))
    return out


def intersects(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two half-open boxes (x0, y0, z0, x1, y1, z1) share a point."""
    return (a[0] < b[3]) & (b[0] < a[3]) & (a[1] < b[4]) & (b[1] < a[4]) & (a[2] < b[5]) & (b[2] < a[5])


def contains(box: Sequence[Column], point: Sequence[Column]) -> Column:
    """Whether a point is in the closed box."""
    return (point[0] >= box[0]) & (point[1] >= box[1]) & (point[2] >= box[2]) & (point[0] <= box[3]) & (point[1] <= box[4]) & (point[2] <= box[5])


def floor_div(a: Column, n) -> Column:
    """a / n rounded down, exactly, for negative a too."""
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    return ((a - F.pmod(a, n)) / n).cast("long")


def expanded(low: Column, high: Column, chunk: int, offset: int = 0) -> tuple[Column, Column]:
    """The least run of whole chunks that covers [low, high)."""
    return floor_div(low - offset, chunk) * chunk + offset, -floor_div(-(high - offset), chunk) * chunk + offset


def shrunk(low: Column, high: Column, chunk: int, offset: int = 0) -> tuple[Column, Column]:
    """The most whole chunks inside [low, high); a point where there are none."""
    a, b = -floor_div(-(low - offset), chunk) * chunk + offset, floor_div(high - offset, chunk) * chunk + offset
    return F.when(a > b, b).otherwise(a), b


def rounded(v: Column, chunk: int, offset: int = 0) -> Column:
    """The nearest chunk border, an even one if two are as near."""
    return (F.rint((v - offset).cast("double") / chunk).cast("long") * chunk + offset).cast("long")


def to_mip_floor(v: Column, res_from: Column, res_to: Column) -> Column:
    return F.floor(v.cast("double") * res_from / res_to).cast("long")


def to_mip_ceil(v: Column, res_from: Column, res_to: Column) -> Column:
    return F.ceil(v.cast("double") * res_from / res_to).cast("long")


def chunk_name(bounds: Sequence[Column]) -> Column:
    """x0-x1_y0-y1_z0-z1 of (x0, x1, y0, y1, z0, z1)."""
    return F.concat_ws("_", *[F.concat(bounds[k].cast("string"), F.lit("-"), bounds[k + 1].cast("string")) for k in (0, 2, 4)])


def morton(coordinates: Sequence[Column], grid: Triple) -> Column:
    """Compressed z-order code: bit i of an axis takes part only while 2**i is less than the grid's size there."""
    out, place = F.lit(0).cast("long"), 0
    for i in range(max(int(g) for g in grid).bit_length()):
        for c, size in zip(coordinates, grid, strict=True):
            if (1 << i) < size:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), place))
                place += 1
    if place > 64:
        raise ValueError(f"a grid of {tuple(grid)} needs {place} bits")
    return F.when(F.greatest(*[c - F.lit(g) for c, g in zip(coordinates, grid, strict=True)]) >= 0, F.raise_error(F.lit("coordinate beyond the grid"))).otherwise(out)


def morton_inverse(code: Column, grid: Triple) -> list[Column]:
    """Grid coordinates of a code."""
    out, place = [F.lit(0).cast("long") for _ in grid], 0
    for i in range(max(int(g) for g in grid).bit_length()):
        for k, size in enumerate(grid):
            if (1 << i) < size:
                out[k] = out[k].bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, place).bitwiseAND(F.lit(1).cast("long")), i))
                place += 1
    return out


def closest_divisor(sizes: Triple, target: Triple) -> tuple[int, ...]:
    """On each axis the divisor of the size that is nearest to the target, the first of those as near."""
    return tuple(min((d for d in range(1, int(n) + 1) if n % d == 0), key=lambda d: abs(d - t)) for n, t in zip(sizes, target, strict=True))


# boxes are six columns: x0, y0, z0, x1, y1, z1


def contains_box(outer: Sequence[Column], inner: Sequence[Column]) -> Column:
    """Whether both corners of the inner box are in the closed outer one."""
    return contains(outer, inner[:3]) & contains(outer, inner[3:])


def overlaps(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two closed boxes share a point; touching is enough."""
    return (a[0] <= b[3]) & (b[0] <= a[3]) & (a[1] <= b[4]) & (b[1] <= a[4]) & (a[2] <= b[5]) & (b[2] <= a[5])


def near_edge(box: Sequence[Column], point: Sequence[Column], distance: int) -> Column:
    """Whether a point is within a distance of one of the planes of the box's sides."""
    out = F.lit(False)
    for k in range(3):
        out = out | (F.abs(point[k] - box[k]) <= distance) | (F.abs(point[k] - box[k + 3]) <= distance)
    return out


def box_size(box: Sequence[Column]) -> list[Column]:
    return [box[k + 3] - box[k] for k in range(3)]


def box_volume(box: Sequence[Column]) -> Column:
    x, y, z = box_size(box)
    return x * y * z


def box_center(box: Sequence[Column]) -> list[Column]:
    return [(box[k] + box[k + 3]).cast("double") / 2 for k in range(3)]


def is_valid(box: Sequence[Column]) -> Column:
    """No side is negative."""
    return F.least(*box_size(box)) >= 0


def is_empty(box: Sequence[Column]) -> Column:
    return F.least(*box_size(box)) <= 0


def is_subvoxel(box: Sequence[Column]) -> Column:
    """A valid box that has less than a voxel on some axis or in all."""
    return is_valid(box) & (box_volume(box) < 1)


def shifted(box: Sequence[Column], by: Sequence[int]) -> list[Column]:
    return [c + by[k % 3] for k, c in enumerate(box)]


def scaled(box: Sequence[Column], by: Sequence[float]) -> list[Column]:
    return [c * by[k % 3] for k, c in enumerate(box)]


def divided(box: Sequence[Column], by: Sequence[int]) -> list[Column]:
    """Both corners by floor division."""
    return [floor_div(c, by[k % 3]) for k, c in enumerate(box)]


BOX_NAME = r"(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)"


def parsed_name(name: Column) -> list[Column]:
    """The box in a file's name, x0-x1_y0-y1_z0-z1 with whatever is before and behind; null where there is none."""
    part = lambda k: F.when(name.rlike(BOX_NAME), F.regexp_extract(name, BOX_NAME, k).cast("long"))
    return [part(k) for k in (1, 3, 5, 2, 4, 6)]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a).cast("double"))


def clamped(a: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> list[Column]:
    return [F.least(F.greatest(v, lo), hi) for v, lo, hi in zip(a, low, high, strict=True)]


def in_regions(box: Sequence[Column], regions: Sequence[Sequence[int]]) -> Column:
    """Whether a box overlaps one of some regions of interest; without any, everything is of interest."""
    if not regions:
        return F.lit(True)
    out = F.lit(False)
    for r in regions:
        out = out | intersects(box, [F.lit(int(k)) for k in r])
    return out
