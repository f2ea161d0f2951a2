"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; where none is named, take a local one, on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="voxlake-checkpoint-")
        sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for what is written and read again."""
    import uuid

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    root = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def least_roots(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each of n nodes' components, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[src], root[dst]), np.maximum(root[src], root[dst])
        open_ = low != high
        if not open_.any():
            return root
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]


def contracted(pairs: DataFrame) -> DataFrame:
    """Edges (u, v) of each partition as stars around the least node of the partition's components.

    What is connected stays so, and no partition sends more edges than it has nodes.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = least_roots(at[: len(u)], at[len(u) :], len(nodes))
            far = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])

    return pairs.mapInArrow(contract, "u long, v long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node of the undirected edges; component is the least node.

    Nulls are no nodes: an edge with a null end is left out. Self-loops and repeated edges are
    allowed; a node that only has self-loops is its own component. No edges give no rows.

    Each round links all larger neighbours to the least one (large star), then each node and
    its smaller neighbours to the least one (small star); a path of n nodes takes O(log n)
    rounds. Every round is cut from its lineage by a checkpoint. Edges between longs are contracted within
    their partitions first.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    e = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if dict(e.dtypes)["u"] == "bigint":
        e = contracted(e)
    e = cut(e.distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).union(loops).distinct()
    known = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m")))).alias("p"))
            .select(F.col("p.u").alias("u"), F.col("p.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        seen = e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
        if seen == known:
            break
        known = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("m", "node").alias("component"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with `name`, 0, 1, ... in the order of columns that tell all rows apart.

    Rows are sorted into ranges, each range's rows are counted, and a row's number is its place in its range behind the rows
    of earlier ones. So there is no task that has all the rows; the driver gets one count a partition.
    """
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__at"), 33)
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*")).collect())
    starts, total = {}, 0
    for k, n in sizes:
        starts[k] = total
        total += n
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    if not starts:
        return ordered.withColumn(name, place).drop("__at")
    known = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    return ordered.withColumn(name, F.element_at(known, part) + place).drop("__at")
