"""Streams of voxel edits: a running volume, and label counts over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from voxlake.functions.geometry import floor_div

EDITS = "ts timestamp, x long, y long, z long, label long"


def latest(edits: DataFrame) -> DataFrame:
    """The last edit of each voxel; of those at one time the greatest label."""
    return edits.groupBy("x", "y", "z").agg(F.max(F.struct("ts", "label")).alias("last")).select("x", "y", "z", "last.label", "last.ts")


def label_counts(edits: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(start, label, n) of each window, final once the watermark has passed it."""
    w = edits.withWatermark("ts", late).groupBy(F.window("ts", every), "label").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "label", "n")


def volume_sink(edits: DataFrame, path: str, chunk: int = 64) -> DataStreamWriter:
    """Keep a volume table at path, partitioned by chunk: each micro-batch rewrites only the chunks it touches.

    A batch that runs again after a failure leaves the same rows, since the last edit of a voxel wins.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = [floor_div(F.col(a), chunk).alias(f"g{a}") for a in "xyz"]
        new = latest(batch).select("*", *keys)
        touched = new.select("gx", "gy", "gz").distinct()
        try:
            old = spark.read.schema("x long, y long, z long, label long, ts timestamp, gx long, gy long, gz long").parquet(path)
            new = new.unionByName(old.join(F.broadcast(touched) if touched.count() < 100_000 else touched, ["gx", "gy", "gz"], "left_semi"))
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        merged = latest(new).select("*", *keys)
        from voxlake.operators.components import cut

        # cut before the partitions that it was read from are overwritten
        cut(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gx", "gy", "gz").parquet(path)

    return edits.writeStream.foreachBatch(merge).outputMode("append")
