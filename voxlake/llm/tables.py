"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.components import numbered

#: Most bytes of keys that are sent to every executor; beyond it the join is a shuffle.
BROADCAST_BYTES = 64 << 20


#: Texts go to Python in batches of so many bytes at most, a longer one alone; rows alone bound nothing.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark, sf_dir: str, name: str) -> DataFrame:
    """A table, in as many partitions as there are cores at least: a file of one row group would be one task."""
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever dots and marks it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def by_place(df: DataFrame) -> DataFrame:
    """df with columns named c0, c1, ...: names can't clash or be misread in what is done with it."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def long_ids(rows: DataFrame, column: str, ids: DataFrame | None = None) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """(rows with the column as a long, a function that puts the ids as they were into columns of a result).

    Whole numbers are only cast. Ids of another type are numbered in their order, which takes a sort of the distinct ones
    and a join; nulls stay null. So what is least stays least. `ids` has the column too if other tables share it.
    """
    kind = rows.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn(column, F.col(column).cast("long")), lambda result, columns: result.select(*[F.col(c).cast(kind).alias(c) if c in columns else F.col(c) for c in result.columns])
    every = rows.select(F.col(column).alias("__id")).where("__id is not null").distinct()
    named = numbered(every, ["__id"], "__n")

    def restored(result: DataFrame, columns: list[str]) -> DataFrame:
        order = result.columns
        for c in columns:
            back = named.select(F.col("__n").alias("__k"), F.col("__id").alias("__v"))
            result = result.join(back, result[c] == back["__k"], "left").drop(c, "__k").withColumnRenamed("__v", c)
        return result.select(*order)

    out = rows.join(named, rows[column] == named["__id"], "left").drop(column, "__id").withColumnRenamed("__n", column)
    return out.select(*rows.columns), restored


def drop_keys(df: DataFrame, keys: DataFrame, column: str, count: int, bytes_each: int = 48) -> DataFrame:
    """Rows of df whose column isn't among keys; rows with a null there stay.

    keys has the column alone. It is broadcast where count rows of it fit BROADCAST_BYTES;
    else both sides are shuffled by the column.
    """
    keys = keys.select(F.col(column).alias("__key"))
    if count * bytes_each <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return df.join(keys, df[column] == keys["__key"], "left_anti")
