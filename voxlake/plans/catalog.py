"""Every named query over the derived relations, and its oracle SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlake.functions import codec, geometry
from voxlake.operators import blocks, graph, grid, mesh, shards, spatial, voxels
from voxlake.operators.components import numbered
from voxlake.plans.fixtures import relation, with_relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LOW, HIGH = (5, 9, 3), (41, 50, 27)
IN_BOX = "x >= 5 AND x < 41 AND y >= 9 AND y < 50 AND z >= 3 AND z < 27"
CENTER = (31, 17, 11)
SMALL = ((0, 0, 0), (12, 12, 6))
SMALL_BOX = "x >= 0 AND x < 12 AND y >= 0 AND y < 12 AND z >= 0 AND z < 6"
HALF = (8, 8, 4)


def query(name: str, *relations: str, sql: str | None = None, recursive: bool = False) -> Callable:
    """Register a function of derived relations, in the order named, and its oracle."""

    def register(f: Callable[..., DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*[relation(spark, sf_dir, r) for r in relations])
        if sql is not None:
            ORACLE_SQL[name] = with_relations(sql, *relations, recursive=recursive)
        return f

    return register


# scans, filters, projections

query("voxelize", "vox", sql="SELECT x, y, z, label FROM vox")(lambda v: v)
query("box_scan", "vox", sql=f"SELECT x, y, z, label FROM vox WHERE {IN_BOX}")(lambda v: voxels.box(v, LOW, HIGH))
query("box_scan_strided", "vox", sql=f"SELECT x, y, z, label FROM vox WHERE {IN_BOX} AND (x - 5) % 3 = 0 AND (y - 9) % 2 = 0 AND (z - 3) % 5 = 0")(lambda v: voxels.strided(v, LOW, HIGH, (3, 2, 5)))
query("where_mask", "vox", sql="SELECT x, y, z, CAST(CASE WHEN label = 3 THEN 255 ELSE 0 END AS BIGINT) AS label FROM vox")(lambda v: voxels.where_mask(v, 3))
query("binary_image", "vox", sql="SELECT x, y, z, TRUE AS is_label FROM vox WHERE label = 3")(lambda v: v.where("label = 3").select("x", "y", "z", F.lit(True).alias("is_label")))
query("mask_except", "vox", sql="SELECT x, y, z, label FROM vox WHERE label IN (2, 5)")(lambda v: voxels.mask_except(v, [2, 5]))
query("mask_preserve_zeros", "vox", sql="SELECT x, y, z, CASE WHEN label IN (2, 5) THEN label ELSE 4294967295 END AS label FROM vox")(lambda v: voxels.mask_except(v, [2, 5], preserve_zeros=True))


@query("channel_scan", "vox", sql="SELECT x, y, z, c, CAST(label * (c + 1) AS BIGINT) AS label FROM vox, (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS c) WHERE c >= 1 AND c < 3")
def channel_scan(v: DataFrame) -> DataFrame:
    channels = v.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return channels.where("c >= 1 and c < 3").select("x", "y", "z", "c", (F.col("label") * (F.col("c") + 1)).alias("label"))


# grids

_GRID = "SELECT CAST(a.v AS BIGINT) AS gx, CAST(b.v AS BIGINT) AS gy, CAST(c.v AS BIGINT) AS gz FROM generate_series(0, 2) a(v), generate_series(0, 3) b(v), generate_series(0, 1) c(v)"
_BOUNDS = f"SELECT gx, gy, gz, gx * 16 AS x0, least((gx + 1) * 16, 64) AS x1, gy * 16 AS y0, least((gy + 1) * 16, 64) AS y1, gz * 16 AS z0, least((gz + 1) * 16, 27) AS z1 FROM ({_GRID})"


def _chunks(spark: SparkSession) -> DataFrame:
    return grid.chunks(spark, LOW, HIGH, (16, 16, 16), bounds=(64, 64, 27))


QUERIES["chunk_grid"] = lambda spark, sf_dir: _chunks(spark)
ORACLE_SQL["chunk_grid"] = _BOUNDS
QUERIES["chunk_names"] = lambda spark, sf_dir: grid.named(_chunks(spark)).select("name")
ORACLE_SQL["chunk_names"] = f"SELECT printf('%d-%d_%d-%d_%d-%d', x0, x1, y0, y1, z0, z1) AS name FROM ({_BOUNDS})"
QUERIES["shell_core_chunks"] = lambda spark, sf_dir: grid.shell(_chunks(spark), LOW, HIGH).select("gx", "gy", "gz")
ORACLE_SQL["shell_core_chunks"] = f"SELECT gx, gy, gz FROM ({_BOUNDS}) EXCEPT SELECT gx, gy, gz FROM ({_BOUNDS}) WHERE x0 >= 5 AND x1 <= 41 AND y0 >= 9 AND y1 <= 50 AND z0 >= 3 AND z1 <= 27"


@query("chunk_exists", "vox", sql=f"SELECT gx, gy, gz, EXISTS (SELECT 1 FROM vox WHERE label = 7 AND x // 16 = gx AND y // 16 = gy AND z // 16 = gz) AS held FROM ({_BOUNDS})")
def chunk_exists(v: DataFrame) -> DataFrame:
    return grid.exists(_chunks(v.sparkSession), v.where("label = 7"), (16, 16, 16)).select("gx", "gy", "gz", "held")


# labels

query("unique_labels", "vox", sql="SELECT DISTINCT label FROM vox UNION SELECT 0 WHERE (SELECT count(*) FROM vox) < 64 * 64 * 32")(lambda v: voxels.unique(v, 64 * 64 * 32))
query("unique_core_shell", "vox", sql=f"SELECT DISTINCT label FROM vox WHERE {IN_BOX}")(lambda v: blocks.unique(v, blocks.palettes(v), LOW, HIGH))
query("renumber", "vox", sql=f"SELECT x, y, z, dense_rank() OVER (ORDER BY label) AS label FROM vox WHERE label <> 2 AND {IN_BOX}")(lambda v: voxels.renumber(voxels.box(v, LOW, HIGH).where("label <> 2")))
query("remap_labels", "vox", "mapping", sql="SELECT x, y, z, coalesce(root, vox.label) AS label FROM vox LEFT JOIN mapping ON vox.label = mapping.label")(voxels.remap)
query("remap_strict", "vox", "mapping", sql="SELECT x, y, z, root AS label FROM vox JOIN mapping ON vox.label = mapping.label")(lambda v, m: voxels.remap(v.where("label between 1 and 5"), m, strict=True))

# nearest, components, boundaries

_D2 = "(x - 31) * (x - 31) + (y - 17) * (y - 17) + (z - 11) * (z - 11)"
_BLOCK_ORDER = "z // 8, y // 8, x // 8, z % 8, y % 8, x % 8"
query("nearest_seed", "vox", sql=f"SELECT x, y, z, {_D2} AS d2 FROM vox WHERE label = 4 AND {_D2} > 0 ORDER BY d2, {_BLOCK_ORDER} LIMIT 1")(lambda v: voxels.nearest(v.where("label = 4"), CENTER).select("x", "y", "z", "d2"))
query("nearest_value", "vox", sql=f"SELECT label FROM vox WHERE {_D2} > 0 ORDER BY {_D2}, {_BLOCK_ORDER} LIMIT 1")(lambda v: voxels.nearest(v, CENTER).select("label"))
query("nearest_unique", "vox", sql=f"SELECT x, y, z, n = 1 AS is_unique FROM (SELECT x, y, z, count(*) OVER () AS n, row_number() OVER (ORDER BY x, y, z) AS k FROM vox WHERE label = 4 AND {_D2} = (SELECT min({_D2}) FROM vox WHERE label = 4)) WHERE k = 1")(
    lambda v: voxels.nearest(v.where("label = 4"), CENTER, include_self=True, tie="c").select("x", "y", "z", (F.col("n_nearest") == 1).alias("is_unique"))
)
_ADJACENT = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"


@query(
    "component26", "vox", recursive=True,
    sql=f"""WITH m AS (SELECT x, y, z FROM vox WHERE label IN (3, 4) AND {IN_BOX}),
    seed AS (SELECT x, y, z FROM m WHERE {_D2} > 0 ORDER BY {_D2}, {_BLOCK_ORDER} LIMIT 1),
    comp AS (SELECT x, y, z FROM seed UNION SELECT b.x, b.y, b.z FROM comp a JOIN m b ON {_ADJACENT}) SELECT x, y, z FROM comp""",
)
def component26(v: DataFrame) -> DataFrame:
    m = voxels.box(v, LOW, HIGH).where("label in (3, 4)")
    return voxels.component_at(m, voxels.nearest(m, CENTER)).select("x", "y", "z")


@query(
    "component_labels", "vox", recursive=True,
    sql=f"""WITH m AS (SELECT x, y, z, ((x + 1048576) * 2097152 + y + 1048576) * 2097152 + z + 1048576 AS id FROM vox WHERE label IN (1, 6) AND {SMALL_BOX}),
    r AS (SELECT id AS component, x, y, z FROM m UNION SELECT a.component, b.x, b.y, b.z FROM r a JOIN m b ON {_ADJACENT})
    SELECT x, y, z, CAST(min(component) AS BIGINT) AS component FROM r GROUP BY x, y, z""",
)
def component_labels(v: DataFrame) -> DataFrame:
    return voxels.components(voxels.box(v, *SMALL).where("label in (1, 6)")).select("x", "y", "z", "component")


_FREE = "NOT (" + " AND ".join(f"EXISTS (SELECT 1 FROM m n WHERE n.x = m.x + ({a}) AND n.y = m.y + ({b}) AND n.z = m.z)" for a, b in voxels.PLANE) + ")"
query("boundary_points", "vox_dense", sql=f"WITH m AS (SELECT x, y, z FROM vox_dense WHERE label < 6) SELECT x, y, z FROM m WHERE {_FREE}")(lambda v: voxels.boundary(v.where("label < 6")).select("x", "y", "z"))
query("point_cloud", "vox_dense", sql=f"WITH m AS (SELECT x, y, z FROM vox_dense WHERE label < 6) SELECT x * 4 AS x, y * 4 AS y, z * 40 AS z FROM m WHERE {_FREE}")(
    lambda v: voxels.boundary(v.where("label < 6")).select((F.col("x") * 4).alias("x"), (F.col("y") * 4).alias("y"), (F.col("z") * 40).alias("z"))
)


@query(
    "pairwise_cloud", "vox", "candidates", recursive=True,
    sql=f"""WITH legs AS (SELECT case_id, cx, cy, cz, CAST(0 AS BIGINT) AS leg, seg1 AS seg FROM candidates UNION ALL SELECT case_id, cx, cy, cz, CAST(1 AS BIGINT), seg2 FROM candidates),
    m0 AS (SELECT case_id, leg, cx, cy, cz, x, y, z FROM legs JOIN vox ON label = seg AND x >= cx - 8 AND x < cx + 8 AND y >= cy - 8 AND y < cy + 8 AND z >= cz - 4 AND z < cz + 4),
    seed AS (SELECT case_id, leg, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY case_id, leg ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz), {_BLOCK_ORDER}) AS k
        FROM m0 WHERE x <> cx OR y <> cy OR z <> cz) WHERE k = 1),
    comp AS (SELECT case_id, leg, x, y, z FROM seed UNION SELECT b.case_id, b.leg, b.x, b.y, b.z FROM comp a JOIN m0 b ON a.case_id = b.case_id AND a.leg = b.leg AND {_ADJACENT}),
    m AS (SELECT DISTINCT case_id, leg, x, y, z FROM comp)
    SELECT case_id, x * 4 AS x, y * 4 AS y, z * 40 AS z, leg AS label FROM m WHERE {_FREE.replace("n.x =", "n.case_id = m.case_id AND n.leg = m.leg AND n.x =")}""",
)
def pairwise_cloud(v: DataFrame, candidates: DataFrame) -> DataFrame:
    return voxels.pairwise_clouds(v, candidates, HALF)


query("scattered_points", "vox", "points", sql="SELECT p.x, p.y, p.z, coalesce(label, 0) AS label FROM (SELECT DISTINCT x, y, z FROM points) p LEFT JOIN vox USING (x, y, z)")(voxels.points)
query("download_point", "vox", sql="SELECT x, y, z, label FROM vox WHERE x >= 26 AND x < 36 AND y >= 14 AND y < 21 AND z = 11")(lambda v: voxels.around(v, CENTER, (10, 7, 1)))

# blocks

_BLOCKS = "SELECT x // 8 AS bx, y // 8 AS by, z // 8 AS bz, label FROM vox"
_PALETTES = f"SELECT bx, by, bz, list_sort(list_distinct(CASE WHEN count(*) < 512 THEN list_append(list(label), 0) ELSE list(label) END)) AS palette FROM ({_BLOCKS}) GROUP BY 1, 2, 3"
_BITS = "CASE WHEN n = 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 WHEN n <= 256 THEN 8 WHEN n <= 65536 THEN 16 ELSE 32 END"
_text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
query("block_palette", "vox", sql=f"SELECT bx, by, bz, array_to_string(palette, ',') AS palette FROM ({_PALETTES})")(lambda v: blocks.palettes(v).select("bx", "by", "bz", _text("palette").alias("palette")))
query("block_bits", "vox", sql=f"SELECT bx, by, bz, CAST({_BITS} AS BIGINT) AS bits FROM (SELECT bx, by, bz, len(palette) AS n FROM ({_PALETTES}))")(lambda v: blocks.palettes(v).select("bx", "by", "bz", "bits"))
query("block_class", "vox", sql=f"SELECT bx, by, bz, CAST(CASE WHEN NOT list_contains(palette, 7) THEN 0 WHEN len(palette) = 1 THEN 1 ELSE 2 END AS BIGINT) AS class FROM ({_PALETTES})")(lambda v: blocks.classify(blocks.palettes(v), 7))
query("block_prune", "vox", sql=f"SELECT bx, by, bz FROM ({_BLOCKS}) WHERE label IN (6, 7) GROUP BY 1, 2, 3")(lambda v: blocks.prune(blocks.palettes(v), [6, 7]).select("bx", "by", "bz"))
query("block_labels", "vox", sql="SELECT DISTINCT label FROM vox UNION SELECT 0")(lambda v: voxels.with_background(blocks.labels(blocks.palettes(v))))
query("block_contains", "vox", sql="SELECT CAST(w AS BIGINT) AS label, EXISTS (SELECT 1 FROM vox WHERE label = w) AS found FROM (SELECT unnest([1, 7, 99]) AS w)")(
    lambda v: blocks.palettes(v).agg(*[F.max(F.array_contains("palette", F.lit(w).cast("long"))).alias(f"h{w}") for w in (1, 7, 99)]).select(F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("label"), F.col(f"h{w}").alias("found")) for w in (1, 7, 99)])).alias("s")).select("s.*")
)
query("block_random_access", "vox", "points", sql=ORACLE_SQL["scattered_points"].split(") SELECT p.x", 1)[1].join(["SELECT p.x", ""]))(lambda v, p: blocks.at(blocks.encode(v), p))
query("block_roundtrip", "vox", sql="SELECT x, y, z, label FROM vox")(lambda v: blocks.decode(blocks.encode(v)))
query("block_remap", "vox", "mapping", sql="SELECT x, y, z, coalesce(root, vox.label) AS label FROM vox LEFT JOIN mapping ON vox.label = mapping.label")(lambda v, m: blocks.decode(blocks.remap(blocks.encode(v), m)))
query("edge_block_clip", "vox", sql=f"SELECT bx, by, bz, array_to_string(palette, ',') AS palette FROM ({_PALETTES.replace('FROM vox', f'FROM vox WHERE {IN_BOX}')})")(lambda v: blocks.clip(v, LOW, HIGH).select("bx", "by", "bz", _text("palette").alias("palette")))

# writes

query("shade_overlay", "vox", "vox_dense", sql=f"SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.z, b.z) AS z, coalesce(b.label, a.label) AS label FROM vox a FULL JOIN (SELECT * FROM vox_dense WHERE {IN_BOX}) b ON a.x = b.x AND a.y = b.y AND a.z = b.z")(lambda v, d: voxels.overlay(v, d, LOW, HIGH))
query("write_merge", "vox", "vox_dense", sql=f"SELECT x, y, z, label FROM vox WHERE NOT ({IN_BOX}) UNION ALL SELECT x, y, z, label FROM vox_dense WHERE {IN_BOX}")(lambda v, d: voxels.replaced(v, d, LOW, HIGH))
query("delete_black_chunks", "vox", sql="SELECT x // 8 AS gx, y // 8 AS gy, z // 8 AS gz FROM vox GROUP BY 1, 2, 3 HAVING NOT bool_or(label > 4)")(
    lambda v: v.groupBy(*[geometry.floor_div(F.col(a), 8).alias(f"g{a}") for a in "xyz"]).agg(F.bool_or(F.col("label") > 4).alias("held")).where("not held").drop("held")
)

# boxes, scales, keys

_BOXES = "SELECT pid, x - 20 AS lo, x + y - 9 AS hi FROM points"


def _boxes(p: DataFrame) -> DataFrame:
    return p.select("pid", (F.col("x") - 20).alias("lo"), (F.col("x") + F.col("y") - 9).alias("hi"))


query("bbox_expand", "points", sql=f"SELECT pid, CAST(floor((lo - 3) / 16.0) * 16 + 3 AS BIGINT) AS lo, CAST(ceil((hi - 3) / 16.0) * 16 + 3 AS BIGINT) AS hi FROM ({_BOXES})")(
    lambda p: _boxes(p).select("pid", *[c.alias(n) for c, n in zip(geometry.expanded(F.col("lo"), F.col("hi"), 16, 3), ("lo", "hi"), strict=True)])
)
query("bbox_shrink", "points", sql=f"SELECT pid, least(lo, hi) AS lo, hi FROM (SELECT pid, CAST(ceil((lo - 3) / 16.0) * 16 + 3 AS BIGINT) AS lo, CAST(floor((hi - 3) / 16.0) * 16 + 3 AS BIGINT) AS hi FROM ({_BOXES}))")(
    lambda p: _boxes(p).select("pid", *[c.alias(n) for c, n in zip(geometry.shrunk(F.col("lo"), F.col("hi"), 16, 3), ("lo", "hi"), strict=True)])
)
query("bbox_round", "points", sql=f"SELECT pid, CAST(round_even((lo - 3) / 16.0, 0) * 16 + 3 AS BIGINT) AS lo, CAST(round_even((hi - 3) / 16.0, 0) * 16 + 3 AS BIGINT) AS hi FROM ({_BOXES})")(
    lambda p: _boxes(p).select("pid", geometry.rounded(F.col("lo"), 16, 3).alias("lo"), geometry.rounded(F.col("hi"), 16, 3).alias("hi"))
)
query("bbox_intersect", "points", sql=f"SELECT pid, greatest(lo, 0) AS lo, least(hi, 30) AS hi FROM ({_BOXES}) WHERE lo < 30 AND 0 < hi")(
    lambda p: _boxes(p).where("lo < 30 and 0 < hi").select("pid", F.greatest("lo", F.lit(0)).cast("long").alias("lo"), F.least("hi", F.lit(30)).cast("long").alias("hi"))
)
query("bbox_units", "points", sql=f"SELECT pid, lo * 40 AS lo_nm, CAST(floor(hi * 40 / 16.0) AS BIGINT) AS hi_vx FROM ({_BOXES})")(
    lambda p: _boxes(p).select("pid", (F.col("lo") * 40).alias("lo_nm"), geometry.floor_div(F.col("hi") * 40, 16).alias("hi_vx"))
)
query("point_to_mip", "points", "scales", sql="SELECT pid, CAST(mip AS BIGINT) AS mip, CAST(floor(x * 4.0 / rx) AS BIGINT) AS x, CAST(floor(y * 4.0 / ry) AS BIGINT) AS y, CAST(floor(z * 40.0 / rz) AS BIGINT) AS z FROM points, scales")(
    lambda p, s: p.crossJoin(F.broadcast(s)).select("pid", F.col("mip").cast("long").alias("mip"), *[geometry.to_mip_floor(F.col(a), F.lit(r), F.col(f"r{a}")).alias(a) for a, r in zip("xyz", (4, 4, 40), strict=True)])
)
query("bbox_to_mip", "points", "scales", sql=f"SELECT pid, CAST(mip AS BIGINT) AS mip, CAST(floor(lo * 4.0 / rx) AS BIGINT) AS lo, CAST(ceil(hi * 4.0 / rx) AS BIGINT) AS hi FROM ({_BOXES}), scales")(
    lambda p, s: _boxes(p).crossJoin(F.broadcast(s)).select("pid", F.col("mip").cast("long").alias("mip"), geometry.to_mip_floor(F.col("lo"), F.lit(4), F.col("rx")).alias("lo"), geometry.to_mip_ceil(F.col("hi"), F.lit(4), F.col("rx")).alias("hi"))
)


@query("downsample_scales", "scales", sql="SELECT CAST(mip AS BIGINT) AS mip, CAST(rx / 4 AS BIGINT) AS fx, CAST(rz / 40 AS BIGINT) AS fz, CAST(floor(35 * 4.0 / rx) AS BIGINT) AS ox, CAST(ceil(1024 * 4.0 / rx) AS BIGINT) AS sx, printf('%d_%d_%d', rx, ry, rz) AS key FROM scales")
def downsample_scales(s: DataFrame) -> DataFrame:
    return s.select(
        F.col("mip").cast("long").alias("mip"), (F.col("rx") / 4).cast("long").alias("fx"), (F.col("rz") / 40).cast("long").alias("fz"),
        geometry.to_mip_floor(F.lit(35), F.lit(4), F.col("rx")).alias("ox"), geometry.to_mip_ceil(F.lit(1024), F.lit(4), F.col("rx")).alias("sx"), F.concat_ws("_", "rx", "ry", "rz").alias("key"),
    )


GRID = (64, 64, 32)
_PLACES = [(a, i, p) for p, (i, a) in enumerate((i, a) for i in range(6) for a in "xyz" if (1 << i) < dict(zip("xyz", GRID, strict=True))[a])]
_MORTON = " | ".join(f"((({a} >> {i}) & 1) << {p})" for a, i, p in _PLACES)
_INVERSE = {a: " | ".join(f"(((code >> {p}) & 1) << {i})" for b, i, p in _PLACES if b == a) for a in "xyz"}


def _morton() -> Column:
    return geometry.morton([F.col(a) for a in "xyz"], GRID)


query("morton_code", "points", sql=f"SELECT pid, {_MORTON} AS code FROM points")(lambda p: p.select("pid", _morton().alias("code")))
query("morton_inverse", "points", sql="SELECT pid, " + ", ".join(f"{e} AS {a}" for a, e in _INVERSE.items()) + " FROM (SELECT pid, pid % 131072 AS code FROM points)")(
    lambda p: p.select("pid", *[c.alias(a) for c, a in zip(geometry.morton_inverse(F.col("pid") % 131072, GRID), "xyz", strict=True)])
)
query("shard_location", "points", sql=f"SELECT pid, (code >> 5) & 63 AS minishard, (code >> 11) & 15 AS shard, lower(printf('%x', (code >> 11) & 15)) AS name FROM (SELECT pid, {_MORTON} AS code FROM points)")(
    lambda p: p.select("pid", _morton().alias("code")).select("pid", *[c.alias(n) for c, n in zip(shards.location(F.col("code"), 5, 6, 4), ("shard", "name", "minishard"), strict=True)])
)
_LABELS = "SELECT CAST(s_suppkey * s_suppkey * 37 AS BIGINT) AS n FROM supplier"
_SHARD_BITS = "least(4, CAST(ceil(log2(greatest(n / 1024.0, 1))) AS BIGINT))"


def _shard_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * F.col("s_suppkey") * 37).cast("long").alias("n"))
    return n.select("n", *[c.alias(a) for c, a in zip(shards.hashed_columns(F.col("n")), ("shard_bits", "minishard_bits"), strict=True)])


QUERIES["shard_params_hashed"] = _shard_params
ORACLE_SQL["shard_params_hashed"] = f"SELECT n, shard_bits, CAST(ceil(log2(greatest(n / (1024.0 * power(2.0, shard_bits)), 1))) AS BIGINT) AS minishard_bits FROM (SELECT n, {_SHARD_BITS} AS shard_bits FROM ({_LABELS}))"
_ITEMS = "SELECT c % 8 AS minishard, c AS key, 100 + c % 57 AS size FROM (SELECT DISTINCT bx + by * 8 + bz * 64 AS c FROM (" + _BLOCKS + "))"
query("minishard_index", "vox", sql=f"SELECT minishard, key, size, CAST(sum(size) OVER w - size AS BIGINT) AS start, CAST(key - coalesce(lag(key) OVER w, 0) AS BIGINT) AS key_delta FROM ({_ITEMS}) WINDOW w AS (PARTITION BY minishard ORDER BY key)")(
    lambda v: shards.minishard_index(
        v.select(*blocks.block_columns(8)).distinct().select((F.col("bx") + F.col("by") * 8 + F.col("bz") * 64).alias("key")).select((F.col("key") % 8).alias("minishard"), "key", (100 + F.col("key") % 57).alias("size")), "minishard", "key", "size"
    )
)


@query(
    "range_coalesce", "points",
    sql="""WITH r AS (SELECT y % 4 AS path, pid * 37 % 4001 AS lo, pid * 37 % 4001 + 1 + x % 9 AS hi FROM points),
    m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
    SELECT path, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM n GROUP BY path, run""",
)
def range_coalesce(p: DataFrame) -> DataFrame:
    r = p.select((F.col("y") % 4).alias("path"), (F.col("pid") * 37 % 4001).alias("lo"), (F.col("pid") * 37 % 4001 + 1 + F.col("x") % 9).alias("hi"))
    return shards.coalesced_ranges(r, "path", "lo", "hi")


# graph

SPEC = graph.LabelSpec()
_RAW = "SELECT pid, (CAST(2 AS BIGINT) << 56) | (x << 46) | (y << 36) | (z << 26) | (pid % 67108864) AS label FROM points"
_FIELDS = ", ".join(f"(label >> {s}) & {(1 << b) - 1} AS {'f' + k}" for k, (s, b) in SPEC.fields().items())


def _labels(p: DataFrame) -> DataFrame:
    fields = {"layer": F.lit(2), "x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "segid": F.col("pid") % (1 << 26)}
    return p.select("pid", graph.encode(fields, SPEC).alias("label"))


query("graph_encode", "points", sql=_RAW)(_labels)
query("graph_decode", "points", sql=f"SELECT pid, {_FIELDS} FROM ({_RAW})")(lambda p: _labels(p).select("pid", *[c.alias("f" + k) for k, c in graph.decode(F.col("label"), SPEC).items()]))
query("graph_roots", "graph_edges", sql="SELECT a.child AS id, CASE WHEN a.child = 0 THEN 0 ELSE coalesce(b.parent, a.parent) END AS root FROM graph_edges a LEFT JOIN graph_edges b ON b.layer = 2 AND b.child = a.parent WHERE a.layer = 1")(
    lambda e: graph.roots(e, e.where("layer = 1").select(F.col("child").alias("id")), 2)
)
query("graph_leaves", "graph_edges", sql="SELECT b.parent AS root, a.child AS leaf FROM graph_edges a JOIN graph_edges b ON b.layer = 2 AND b.child = a.parent WHERE a.layer = 1")(
    lambda e: graph.leaves(e, e.where("layer = 2").select(F.col("parent").alias("root")).distinct(), 2)
)
query("chunk_mappings", "graph_edges", sql="SELECT parent, array_to_string(list_sort(list(child)), ',') AS children FROM graph_edges WHERE layer = 1 GROUP BY parent")(lambda e: graph.chunk_mappings(e).select("parent", _text("children").alias("children")))
query("agglomerate_cutout", "vox", "graph_edges", sql=f"SELECT x, y, z, coalesce(parent, label) AS label FROM vox LEFT JOIN graph_edges ON layer = 1 AND child = label WHERE {IN_BOX}")(
    lambda v, e: voxels.remap(voxels.box(v, LOW, HIGH), graph.roots(e, v.select(F.col("label").alias("id")).distinct(), 2, stop_layer=2).select(F.col("id").alias("label"), "root"))
)

# spatial index

QUERY_BOX = (10, 10, 5, 40, 50, 9)
query("spatial_query", "spatial_cells", sql="SELECT DISTINCT label FROM spatial_cells WHERE x0 < 40 AND 10 < x1 AND y0 < 50 AND 10 < y1 AND z0 < 9 AND 5 < z1")(lambda s: spatial.query(s, QUERY_BOX, 16))
query("label_bbox", "spatial_cells", sql="SELECT label, min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1 FROM spatial_cells GROUP BY label")(spatial.label_box)
query("label_files", "spatial_cells", sql="SELECT label, count(DISTINCT f) AS n_files, array_to_string(list_sort(list_distinct(list(f))), ',') AS files FROM (SELECT label, printf('%d_%d_%d', cx, cy, cz) AS f FROM spatial_cells) GROUP BY label")(spatial.label_files)
query("spatial_gap", "spatial_cells", sql="SELECT CAST(a.v AS BIGINT) AS cx, CAST(b.v AS BIGINT) AS cy, CAST(c.v AS BIGINT) AS cz FROM generate_series(0, 4) a(v), generate_series(0, 3) b(v), generate_series(0, 2) c(v) EXCEPT SELECT cx, cy, cz FROM spatial_cells")(
    lambda s: spatial.gaps(grid.chunks(s.sparkSession, (0, 0, 0), (80, 64, 48), (16, 16, 16)).select(*[F.col(f"g{a}").alias(f"c{a}") for a in "xyz"]), s)
)

# meshes and skeletons

_CORNERS = ("v0", "v1", "v2")
query("mesh_edges", "mesh_faces", sql="SELECT least(v0, v1) AS a, greatest(v0, v1) AS b FROM mesh_faces UNION ALL SELECT least(v1, v2), greatest(v1, v2) FROM mesh_faces UNION ALL SELECT least(v0, v2), greatest(v0, v2) FROM mesh_faces")(mesh.edges)
query("mesh_triangles", "mesh_vertices", "mesh_faces", sql="SELECT v0, v1, v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM mesh_faces JOIN mesh_vertices a ON a.vid = v0 JOIN mesh_vertices b ON b.vid = v1 JOIN mesh_vertices c ON c.vid = v2")(mesh.triangles)
query("mesh_consolidate", "mesh_vertices", "mesh_faces", sql="WITH n AS (SELECT vid, dense_rank() OVER (ORDER BY x, y, z) - 1 AS new FROM mesh_vertices) SELECT DISTINCT a.new AS v0, b.new AS v1, c.new AS v2 FROM mesh_faces JOIN n a ON a.vid = v0 JOIN n b ON b.vid = v1 JOIN n c ON c.vid = v2")(lambda v, f: mesh.consolidate(v, f)[1])
query("mesh_dedupe_boundary", "mesh_vertices", sql="SELECT vid, CASE WHEN count(*) OVER w = 2 AND (x % 4 = 0 OR y % 4 = 0 OR z % 4 = 0) THEN min(vid) OVER w ELSE vid END AS new FROM mesh_vertices WINDOW w AS (PARTITION BY x, y, z)")(lambda v: mesh.dedupe_boundary(v, 4))
query("mesh_crop", "mesh_vertices", "mesh_faces", sql="WITH i AS (SELECT vid FROM mesh_vertices WHERE x BETWEEN 1 AND 6 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 3) SELECT v0, v1, v2 FROM mesh_faces WHERE v0 IN (FROM i) AND v1 IN (FROM i) AND v2 IN (FROM i)")(lambda v, f: mesh.crop(v, f, (1, 0, 0), (6, 7, 3))[1])
query("mesh_concat", "mesh_vertices", sql="WITH m AS (SELECT vid % 3 AS mesh, vid // 3 AS vid, x FROM mesh_vertices), s AS (SELECT mesh, sum(count(*)) OVER (ORDER BY mesh) - count(*) AS start FROM m GROUP BY mesh) SELECT mesh, vid, x, CAST(start + vid AS BIGINT) AS new FROM m JOIN s USING (mesh)")(
    lambda v: mesh.concatenated(v.select((F.col("vid") % 3).alias("mesh"), geometry.floor_div(F.col("vid"), 3).alias("vid"), "x"))
)
query("mesh_quantize", "mesh_vertices", sql="SELECT vid, " + ", ".join(f"CAST(greatest(least(round_even(({a} - 1.0) / 6.0 * 1023, 0), 1023), 0) AS BIGINT) AS {a}" for a in "xyz") + " FROM mesh_vertices")(lambda v: mesh.quantized(v, (1, 1, 1), (6, 6, 6), 10))


def _skeleton(faces: DataFrame) -> DataFrame:
    return faces.select(F.col("v0").alias("a"), F.col("v1").alias("b")).where("v0 % 7 = 0 and v0 <> v1")


_SKEL = "SELECT v0 AS a, v1 AS b FROM mesh_faces WHERE v0 % 7 = 0 AND v0 <> v1"
query("skel_cable_length", "mesh_vertices", "mesh_faces", sql=f"SELECT CAST(round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 3) AS DOUBLE) AS length, count(*) AS n_edges FROM (SELECT DISTINCT a, b FROM ({_SKEL})) e JOIN mesh_vertices a ON a.vid = e.a JOIN mesh_vertices b ON b.vid = e.b")(
    lambda v, f: mesh.cable_length(v, _skeleton(f)).select(F.round("length", 3).alias("length"), "n_edges")
)
query(
    "skel_components", "mesh_vertices", "mesh_faces", recursive=True,
    sql=f"WITH e AS (SELECT a, b FROM ({_SKEL}) UNION SELECT b, a FROM ({_SKEL})), r AS (SELECT vid AS component, vid FROM mesh_vertices UNION SELECT r.component, e.b FROM r JOIN e ON e.a = r.vid) SELECT vid, min(component) AS component FROM r GROUP BY vid",
)(lambda v, f: mesh.skeleton_components(v, _skeleton(f)))
query("skel_consolidate", "mesh_vertices", "mesh_faces", sql=f"WITH n AS (SELECT vid, dense_rank() OVER (ORDER BY x, y, z) - 1 AS new FROM mesh_vertices) SELECT DISTINCT least(p.new, q.new) AS a, greatest(p.new, q.new) AS b FROM ({_SKEL}) e JOIN n p ON p.vid = e.a JOIN n q ON q.vid = e.b WHERE p.new <> q.new")(
    lambda v, f: _consolidated(v, _skeleton(f))
)


def _consolidated(v: DataFrame, e: DataFrame) -> DataFrame:
    n = v.join(numbered(v.select("x", "y", "z").distinct(), ["x", "y", "z"], "new"), ["x", "y", "z"]).select("vid", "new")
    out = e.join(n.select(F.col("vid").alias("a"), F.col("new").alias("p")), "a").join(n.select(F.col("vid").alias("b"), F.col("new").alias("q")), "b")
    return out.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


# others

query("cache_stats", "vox", sql=f"SELECT bz AS mip, count(*) AS num_files, CAST(sum(n) AS BIGINT) AS num_bytes FROM (SELECT bx, by, bz, count(*) AS n FROM ({_BLOCKS}) GROUP BY 1, 2, 3) GROUP BY bz")(
    lambda v: v.select(*blocks.block_columns(8)).groupBy("bx", "by", "bz").agg(F.count("*").alias("n")).groupBy(F.col("bz").alias("mip")).agg(F.count("*").alias("num_files"), F.sum("n").alias("num_bytes"))
)
query("time_frames", "frames", sql="SELECT t, count(*) AS n_voxels, count(DISTINCT label) AS n_labels, max(label) AS top FROM frames WHERE t BETWEEN 3 AND 20 GROUP BY t")(
    lambda f: f.where("t between 3 and 20").groupBy("t").agg(F.count("*").alias("n_voxels"), F.countDistinct("label").alias("n_labels"), F.max("label").alias("top"))
)
query("moving_average", "frames", sql="SELECT x, y, t, CAST(sum(label) OVER (PARTITION BY x, y ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS total3 FROM frames")(
    lambda f: f.select("x", "y", "t", F.sum("label").over(W.partitionBy("x", "y").orderBy("t").rowsBetween(-2, 0)).alias("total3"))
)


@query("lru_split", "vox", "points", sql="WITH want AS (SELECT DISTINCT x // 8 AS bx, y // 8 AS by, z // 8 AS bz FROM points), held AS (SELECT DISTINCT x // 8 AS bx, y // 8 AS by, z // 8 AS bz FROM vox WHERE label = 7) SELECT *, EXISTS (SELECT 1 FROM held h WHERE h.bx = want.bx AND h.by = want.by AND h.bz = want.bz) AS hit FROM want")
def lru_split(v: DataFrame, p: DataFrame) -> DataFrame:
    want, held = p.select(*blocks.block_columns(8)).distinct(), v.where("label = 7").select(*blocks.block_columns(8)).distinct()
    hit = want.join(held, blocks.BLOCK, "left_semi").withColumn("hit", F.lit(True))
    return hit.union(want.join(held, blocks.BLOCK, "left_anti").withColumn("hit", F.lit(False)))


query("codec_binary_roundtrip", "vox", sql="SELECT x, y, z, label FROM vox")(lambda v: codec.roundtrip(v, (32, 32, 32)))
