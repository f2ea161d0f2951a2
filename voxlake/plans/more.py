"""Further named queries over the derived relations, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import geometry, hashing
from voxlake.operators import blocks, graph, grid, mesh, series, spatial, voxels
from voxlake.plans.fixtures import relation, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *relations: str, sql: str, recursive: bool = False) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*[relation(spark, sf_dir, r) for r in relations])
        ORACLE_SQL[name] = with_relations(sql, *relations, recursive=recursive)
        return f

    return register


BOX = ["x0", "y0", "z0", "x1", "y1", "z1"]
_BOXES = "SELECT pid, x - 3 AS x0, y - 30 AS y0, z AS z0, x + y % 9 - 3 AS x1, y + z AS y1, z + x % 5 AS z1 FROM points"
_boxes = lambda p: p.selectExpr("pid", "x - 3 as x0", "y - 30 as y0", "z as z0", "x + y % 9 - 3 as x1", "y + z as y1", "z + x % 5 as z1")
_cols = lambda: [F.col(c) for c in BOX]
_FIXED = (0, -10, 0, 40, 60, 32)
_fixed = lambda: [F.lit(k).cast("long") for k in _FIXED]
_VOL = "(x1 - x0) * (y1 - y0) * (z1 - z0)"


@query(
    "bbox_predicates", "points",
    sql=f"""SELECT pid, x0 >= 0 AND y0 >= -10 AND z0 >= 0 AND x0 <= 40 AND y0 <= 60 AND z0 <= 32 AND x1 >= 0 AND y1 >= -10 AND z1 >= 0 AND x1 <= 40 AND y1 <= 60 AND z1 <= 32 AS inside,
    x0 <= 40 AND 0 <= x1 AND y0 <= 60 AND -10 <= y1 AND z0 <= 32 AND 0 <= z1 AS touches,
    abs(x0) <= 2 OR abs(x0 - 40) <= 2 OR abs(y0 + 10) <= 2 OR abs(y0 - 60) <= 2 OR abs(z0) <= 2 OR abs(z0 - 32) <= 2 AS edge,
    x1 >= x0 AND y1 >= y0 AND z1 >= z0 AS valid, least(x1 - x0, y1 - y0, z1 - z0) <= 0 AS empty, x1 >= x0 AND y1 >= y0 AND z1 >= z0 AND {_VOL} < 1 AS subvoxel,
    x0 < 30 AND 10 < x1 AND y0 < 30 AND 10 < y1 AND z0 < 9 AND 2 < z1 AS roi FROM ({_BOXES})""",
)
def bbox_predicates(p: DataFrame) -> DataFrame:
    b = _cols()
    return _boxes(p).select(
        "pid", geometry.contains_box(_fixed(), b).alias("inside"), geometry.overlaps(b, _fixed()).alias("touches"), geometry.near_edge(_fixed(), b[:3], 2).alias("edge"),
        geometry.is_valid(b).alias("valid"), geometry.is_empty(b).alias("empty"), geometry.is_subvoxel(b).alias("subvoxel"), geometry.in_regions(b, [(10, 10, 2, 30, 30, 9)]).alias("roi"),
    )


_EACH = [(c, k) for k, c in enumerate(BOX)]


@query(
    "bbox_arithmetic", "points",
    sql="SELECT pid, " + ", ".join(f"{c} + {(5, -7, 2)[k % 3]} AS a{c}, {c} * {(2, 3, 4)[k % 3]} AS m{c}, CAST(floor({c} / {(2, 3, 4)[k % 3]}.0) AS BIGINT) AS d{c}" for c, k in _EACH) + f", {_VOL} AS volume, (y0 + y1) / 2.0::DOUBLE AS center FROM ({_BOXES})",
)
def bbox_arithmetic(p: DataFrame) -> DataFrame:
    b = _cols()
    made = [c.alias(m + n) for m, cs in (("a", geometry.shifted(b, (5, -7, 2))), ("m", geometry.scaled(b, (2, 3, 4))), ("d", geometry.divided(b, (2, 3, 4)))) for c, n in zip(cs, BOX, strict=True)]
    return _boxes(p).select("pid", *made, geometry.box_volume(b).alias("volume"), geometry.box_center(b)[1].alias("center"))


@query("bbox_names", "points", sql=f"SELECT pid, {', '.join(BOX)} FROM ({_BOXES})")
def bbox_names(p: DataFrame) -> DataFrame:
    """To a file's name and back."""
    b = _cols()
    named = _boxes(p).select("pid", F.concat(F.lit("s3_x/"), geometry.chunk_name([b[0], b[3], b[1], b[4], b[2], b[5]]), F.lit(".gz")).alias("name"))
    return named.select("pid", *[c.alias(n) for c, n in zip(geometry.parsed_name(F.col("name")), BOX, strict=True)])


query("bbox_from_points", "vox", sql="SELECT label, " + ", ".join(f"min({a}) AS {a}0, max({a}) + 1 AS {a}1" for a in "xyz") + " FROM vox GROUP BY label")(lambda v: spatial.from_points(v, ["label"]))


@query("vec_ops", "points", sql="SELECT pid, x * 2 + y * 3 + z * 5 AS dot, round(sqrt(CAST(x * x + y * y + z * z AS DOUBLE)), 9) AS length, greatest(least(x, 40), 10) AS cx FROM points")
def vec_ops(p: DataFrame) -> DataFrame:
    xyz = [F.col(a) for a in "xyz"]
    low, high = ([F.lit(k).cast("long") for k in t] for t in ((10, 10, 10), (40, 40, 20)))
    return p.select("pid", geometry.dot(xyz, [F.lit(k).cast("long") for k in (2, 3, 5)]).alias("dot"), F.round(geometry.length(xyz), 9).alias("length"), geometry.clamped(xyz, low, high)[0].alias("cx"))


# graph


@query("graph_chunk_position", "points", sql="SELECT pid, CAST(floor((x * 4 - 5) / 16.0) AS BIGINT) AS gx, CAST(floor((y * 4 - 0) / 16.0) AS BIGINT) AS gy, CAST(floor((z - 1) / 8.0) AS BIGINT) AS gz FROM points")
def graph_chunk_position(p: DataFrame) -> DataFrame:
    at = graph.chunk_position({a: F.col(a) for a in "xyz"}, (16, 16, 8), (5, 0, 1), (4, 4, 1))
    return p.select("pid", *[c.alias(f"g{a}") for a, c in at.items()])


@query("graph_chunk_box", "points", sql="SELECT pid, x * 64 + 5 AS x0, y * 64 AS y0, z * 32 + 1 AS z0, x * 64 + 69 AS x1, y * 64 + 64 AS y1, z * 32 + 33 AS z1 FROM points")
def graph_chunk_box(p: DataFrame) -> DataFrame:
    return p.select("pid", *[c.alias(n) for c, n in zip(graph.chunk_box({a: F.col(a) for a in "xyz"}, (16, 16, 8), (5, 0, 1), layer=4), BOX, strict=True)])


query("graph_leaves_stop", "graph_edges", sql="SELECT DISTINCT parent AS root, child AS leaf FROM graph_edges WHERE layer = 2")(lambda e: graph.leaves(e, e.where("layer = 2").select(F.col("parent").alias("root")).distinct(), 2, stop_layer=2))
_SEGID = "CAST((1::BIGINT << 56) | ((child % 8) << 46) | ((child % 4) << 36) | ((child % 2) << 26) | child AS BIGINT)"


@query("graph_leaves_box", "graph_edges", sql="SELECT b.parent AS root, " + _SEGID.replace("child", "a.child") + " AS leaf FROM graph_edges a JOIN graph_edges b ON b.layer = 2 AND b.child = a.parent WHERE a.layer = 1 AND a.child % 8 >= 2 AND a.child % 8 < 5 AND a.child % 4 < 3")
def graph_leaves_box(e: DataFrame) -> DataFrame:
    """Supervoxels of roots, in a box of chunks by their own labels' bits."""
    c = F.col("child")
    label = graph.encode({"layer": F.lit(1), "x": c % 8, "y": c % 4, "z": c % 2, "segid": c})
    named = e.where("layer = 1").select("layer", label.alias("child"), "parent").union(e.where("layer = 2").select("layer", "child", "parent"))
    return graph.leaves(named, e.where("layer = 2").select(F.col("parent").alias("root")).distinct(), 2, box=((2, 0, 0), (5, 3, 2)))


_CHOSEN = "SELECT o.ordinal, o.id, e.child FROM (SELECT row_number() OVER (ORDER BY parent) AS ordinal, parent AS id FROM (SELECT DISTINCT parent FROM graph_edges WHERE layer = 1) WHERE parent % 3 <> 1) o JOIN graph_edges e ON e.layer = 1 AND e.parent = o.id"


def _segments(v: DataFrame, e: DataFrame, zeros: bool) -> DataFrame:
    chosen = e.where("layer = 1").select("parent").distinct().where("parent % 3 <> 1").select(F.col("parent").alias("ordinal"), F.col("parent").alias("id"))
    return graph.segments(v, e, chosen, 1, zeros)


query("graph_segments", "vox", "graph_edges", sql=f"SELECT x, y, z, max(id) AS label FROM vox JOIN ({_CHOSEN}) ON child = label GROUP BY x, y, z")(lambda v, e: _segments(v, e, False))
query("graph_segments_zeros", "vox", "graph_edges", sql=f"SELECT x, y, z, coalesce(max(id), 4294967295) AS label FROM vox LEFT JOIN ({_CHOSEN}) ON child = label GROUP BY x, y, z")(lambda v, e: _segments(v, e, True))

# contours

_HELD = ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM m o WHERE o.x = m.x + ({a}) AND o.y = m.y + ({b}) AND o.z = m.z) THEN 0 ELSE 1 END AS f{k}" for k, (a, b) in enumerate(voxels.RING))
_GAPS = "f0 + f2 + f4 + f6 - " + " - ".join(f"f{k} * f{k + 1} * f{(k + 2) % 8}" for k in (0, 2, 4, 6))
query("contour_multiset", "vox_dense", sql=f"WITH m AS (SELECT x, y, z FROM vox_dense WHERE label < 6), r AS (SELECT x, y, z, {_HELD} FROM m) SELECT x, y, z, CAST(CASE WHEN f0 + f1 + f2 + f3 + f4 + f5 + f6 + f7 = 8 THEN 1 ELSE {_GAPS} END AS BIGINT) AS n FROM r WHERE f0 + f2 + f4 + f6 > 0")(
    lambda v: voxels.contours(v.where("label < 6")).select("x", "y", "z", "n")
)

# meshes and skeletons

_SKEL = "SELECT v0 AS a, v1 AS b FROM mesh_faces WHERE v0 % 7 = 0 AND v0 <> v1"
_skeleton = lambda f: f.select(F.col("v0").alias("a"), F.col("v1").alias("b")).where("v0 % 7 = 0 and v0 <> v1")
query(
    "mesh_crop_reindexed", "mesh_vertices", "mesh_faces",
    sql="WITH i AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM mesh_vertices WHERE x BETWEEN 1 AND 6 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 3) SELECT a.new AS v0, b.new AS v1, c.new AS v2 FROM mesh_faces JOIN i a ON a.vid = v0 JOIN i b ON b.vid = v1 JOIN i c ON c.vid = v2",
)(lambda v, f: mesh.cropped(v, f, (1, 0, 0), (6, 7, 3))[1])
query("mesh_dequantize", "mesh_vertices", sql="SELECT vid, " + ", ".join(f"round(CAST({a} AS DOUBLE) / 1023 * 6 + 1, 9) AS {a}" for a in "xyz") + " FROM mesh_vertices")(
    lambda v: mesh.dequantized(v, (1, 1, 1), (6, 6, 6), 10).select("vid", *[F.round(a, 9).alias(a) for a in "xyz"])
)
query("mesh_fragments", "graph_edges", sql="SELECT parent AS label, 'f' || child AS fragment FROM graph_edges WHERE layer = 1 AND parent % 2 = 0")(
    lambda e: mesh.fragments(e.where("layer = 1").groupBy(F.col("parent").alias("label")).agg(F.collect_list(F.concat(F.lit("f"), F.col("child").cast("string"))).alias("fragments")), e.where("parent % 2 = 0").select(F.col("parent").alias("label")))
)
query(
    "skel_connected", "mesh_vertices", "mesh_faces",
    sql=f"WITH e AS ({_SKEL}), i AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM mesh_vertices WHERE vid IN (SELECT a FROM e UNION SELECT b FROM e)) SELECT p.new AS a, q.new AS b FROM e JOIN i p ON p.vid = e.a JOIN i q ON q.vid = e.b",
)(lambda v, f: mesh.connected_vertices(v, _skeleton(f))[1])
query(
    "skel_merge", "mesh_vertices", "mesh_faces",
    sql="WITH n AS (SELECT vid, dense_rank() OVER (ORDER BY x, y, z) - 1 AS new FROM mesh_vertices) SELECT DISTINCT least(p.new, q.new) AS a, greatest(p.new, q.new) AS b FROM (SELECT v0 AS a, v1 AS b FROM mesh_faces WHERE v0 % 7 = 0 AND v0 <> v1 UNION SELECT v1, v2 FROM mesh_faces WHERE v0 % 5 = 0) e JOIN n p ON p.vid = e.a JOIN n q ON q.vid = e.b WHERE p.new <> q.new",
)(lambda v, f: mesh.merged_skeletons([(v, _skeleton(f)), (v, f.where("v0 % 5 = 0").select(F.col("v1").alias("a"), F.col("v2").alias("b")))])[1])

# others

query(
    "spatial_tables", "spatial_cells",
    sql="WITH f AS (SELECT cx, cy, cz, row_number() OVER (ORDER BY cx, cy, cz) - 1 AS file_id FROM (SELECT DISTINCT cx, cy, cz FROM spatial_cells)) SELECT file_id, printf('%d_%d_%d', cx, cy, cz) AS filename, label, x0, y0, z0, x1, y1, z1 FROM spatial_cells JOIN f USING (cx, cy, cz)",
)(lambda s: (lambda t: t[1].join(t[0], "file_id"))(spatial.tables(s)))
query("block_bitstream", "vox", sql="SELECT x, y, z, label FROM vox WHERE label = 3")(lambda v: blocks.decode(blocks.bitstream(blocks.encode(v), 3)))
query(
    "moving_average_padded", "frames",
    sql="""WITH r AS (SELECT x, y, t, CAST(label AS DOUBLE) AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY x, y) AS n, list(label) OVER (PARTITION BY x, y ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM frames WINDOW w AS (PARTITION BY x, y ORDER BY t)),
    k AS (SELECT x, y, t, n, a, unnest([i, i - 1, i - 2, i - 3]) AS j FROM r),
    m AS (SELECT x, y, t, a, n, CASE WHEN j >= 0 THEN j ELSE (-j - 1) % (2 * n) END AS q FROM k)
    SELECT x, y, t, round(avg(CAST(a[CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END + 1] AS DOUBLE)), 9) AS average FROM m GROUP BY x, y, t""",
)(lambda f: series.moving_average(f, ["x", "y"], "t", "label", 4).select("x", "y", "t", F.round("average", 9).alias("average")))


@query("chunk_cells", "points", sql="SELECT CAST(a.v AS BIGINT) AS gx, CAST(b.v AS BIGINT) AS gy, CAST(c.v AS BIGINT) AS gz FROM generate_series(-2, 1) a(v), generate_series(0, 2) b(v), generate_series(-1, 0) c(v)")
def chunk_cells(p: DataFrame) -> DataFrame:
    """A grid with negative places and an offset."""
    return grid.chunks(p.sparkSession, (-20, 3, -5), (30, 40, 9), (16, 16, 16), (3, 3, 2)).select("gx", "gy", "gz")


def _murmur_sql() -> str:
    """The hash of 8-byte keys by arithmetic on numbers of 32 bits."""
    m = 4294967295
    mul = lambda a, c: f"CAST((CAST({a} AS HUGEINT) * {c}) & {m} AS BIGINT)"
    rot = lambda a, r: f"((({a} << {r}) & {m}) | ({a} >> {32 - r}))"
    steps = [
        {"lo": f"pid & {m}", "hi": f"(pid >> 32) & {m}"},
        {"p": mul("lo", 0x239B961B), "q": mul("hi", 0xAB0E9789)},
        {"h1": f"xor({mul(rot('p', 15), 0xAB0E9789)}, 8)", "h2": f"xor({mul(rot('q', 16), 0x38B34AE5)}, 8)"},
        {"a": f"(h1 + h2 + 16) & {m}"},
        {"b": f"(h2 + a) & {m}", "c": f"(8 + a) & {m}"},
    ]
    text = "SELECT pid FROM points"
    names = ["pid"]
    for step in steps:
        text = f"SELECT {', '.join(names)}, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({text})"
        names += step
    for factor, shift in ((None, 16), (0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        mixed = {n: f"xor({mul(n, factor) if factor else n}, {mul(n, factor) if factor else n} >> {shift})" for n in "abc"}
        text = f"SELECT pid, {', '.join(f'{e} AS {n}' for n, e in mixed.items())} FROM ({text})"
    text = f"SELECT pid, b, (a + b + c + c) & {m} AS a FROM ({text})"
    text = f"SELECT pid, a, (b + a) & {m} AS b FROM ({text})"
    return f"SELECT pid, CAST(CAST(a AS HUGEINT) + (CAST(CASE WHEN b >= 2147483648 THEN b - 4294967296 ELSE b END AS HUGEINT) * 4294967296) AS BIGINT) AS h FROM ({text})"


query("murmur3", "points", sql=_murmur_sql())(lambda p: p.select("pid", hashing.murmur3_x86_128_low("pid").alias("h")))
