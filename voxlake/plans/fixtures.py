"""Volumes and related relations that the catalogue's queries run on, each derived from the driver's tables.

Every text runs unchanged on Spark and DuckDB. Columns are BIGINT but for `scales`, which are INT.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _volume(nx: int, ny: int, nz: int) -> str:
    return (
        f"SELECT CAST(l_partkey % {nx} AS BIGINT) AS x, CAST(l_orderkey % {ny} AS BIGINT) AS y, CAST(l_suppkey % {nz} AS BIGINT) AS z, "
        "CAST(max(l_linenumber) AS BIGINT) AS label FROM lineitem GROUP BY 1, 2, 3"
    )


RELATIONS: dict[str, str] = {
    "vox": _volume(64, 64, 32),
    "vox_dense": _volume(32, 32, 16),
    "points": "SELECT CAST(event_id AS BIGINT) AS pid, CAST(user_id % 64 AS BIGINT) AS x, CAST(event_id % 64 AS BIGINT) AS y, CAST(floor(value) AS BIGINT) % 32 AS z FROM events",
    "mapping": "SELECT CAST(n_nationkey AS BIGINT) AS label, CAST(100 + n_regionkey AS BIGINT) AS root FROM nation WHERE n_nationkey BETWEEN 1 AND 5",
    "candidates": (
        "SELECT CAST(c_custkey AS BIGINT) AS case_id, CAST(c_custkey % 7 + 1 AS BIGINT) AS seg1, CAST(c_nationkey % 7 + 1 AS BIGINT) AS seg2, "
        "CAST((c_custkey * 7) % 64 AS BIGINT) AS cx, CAST((c_custkey * 11) % 64 AS BIGINT) AS cy, CAST((c_custkey * 3) % 32 AS BIGINT) AS cz FROM customer WHERE c_custkey <= 20"
    ),
    "graph_edges": (
        "SELECT CAST(1 AS BIGINT) AS layer, CAST(s_suppkey AS BIGINT) AS child, CAST(1000000 + s_nationkey AS BIGINT) AS parent FROM supplier "
        "UNION ALL SELECT CAST(2 AS BIGINT) AS layer, CAST(1000000 + n_nationkey AS BIGINT) AS child, CAST(2000000 + n_regionkey AS BIGINT) AS parent FROM nation"
    ),
    "spatial_cells": (
        "SELECT CAST(floor((l_partkey % 64) / 16) AS BIGINT) AS cx, CAST(floor((l_orderkey % 64) / 16) AS BIGINT) AS cy, CAST(floor((l_suppkey % 32) / 16) AS BIGINT) AS cz, "
        "CAST(l_linenumber AS BIGINT) AS label, CAST(min(l_partkey % 64) AS BIGINT) AS x0, CAST(min(l_orderkey % 64) AS BIGINT) AS y0, CAST(min(l_suppkey % 32) AS BIGINT) AS z0, "
        "CAST(max(l_partkey % 64) + 1 AS BIGINT) AS x1, CAST(max(l_orderkey % 64) + 1 AS BIGINT) AS y1, CAST(max(l_suppkey % 32) + 1 AS BIGINT) AS z1 FROM lineitem GROUP BY 1, 2, 3, 4"
    ),
    "mesh_vertices": "SELECT CAST(p_partkey AS BIGINT) AS vid, CAST(p_size % 8 AS BIGINT) AS x, CAST(p_partkey % 10 AS BIGINT) AS y, CAST(p_partkey % 4 AS BIGINT) AS z FROM part WHERE p_partkey <= 200",
    "mesh_faces": (
        "SELECT DISTINCT CAST(l_partkey % 200 + 1 AS BIGINT) AS v0, CAST((l_partkey + l_suppkey) % 200 + 1 AS BIGINT) AS v1, CAST(l_orderkey % 200 + 1 AS BIGINT) AS v2 FROM lineitem WHERE l_linenumber = 1"
    ),
    "frames": "SELECT CAST(day(ts) AS BIGINT) AS t, CAST(user_id % 16 AS BIGINT) AS x, CAST(event_id % 16 AS BIGINT) AS y, CAST(max(floor(value)) AS BIGINT) AS label FROM events GROUP BY 1, 2, 3",
    "scales": (
        "SELECT 0 AS mip, 4 AS rx, 4 AS ry, 40 AS rz, 35 AS ox, 0 AS oy, 1 AS oz UNION ALL SELECT 1, 8, 8, 40, 17, 0, 1 UNION ALL "
        "SELECT 2, 16, 16, 40, 8, 0, 1 UNION ALL SELECT 3, 32, 32, 40, 4, 0, 1"
    ),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables in sf_dir."""
    text = RELATIONS[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_relations(sql: str, *names: str, recursive: bool = False) -> str:
    """Oracle SQL with the relations that it uses in front."""
    heads = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names)
    body = re.sub(r"\bby\b", '"by"', sql.strip())  # a keyword, unless it is quoted
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads}, {body[5:]}"
    return f"WITH {heads} {body}"
