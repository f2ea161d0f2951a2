"""Operators on ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, n: int, name: str = "average") -> DataFrame:
    """The mean of each row's last n values, its own among them. What is before the first row is its mirror image: the first value, the second, ..."""
    if n < 1:
        raise ValueError("the window must be positive")
    ordered = W.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(ordered) - 1)
    if n > 1:
        # the first n - 1 values, and how many there are in all
        first = W.partitionBy(*by)
        rows = rows.withColumn("__n", F.count("*").over(first)).withColumn("__first", F.array_sort(F.collect_list(F.when(F.col("__i") < n, F.struct("__i", F.col(value).alias("v")))).over(first)))
    total = F.lit(0.0)
    for k in range(n):
        own = F.lag(value, k).over(ordered).cast("double")
        if k:
            at = F.pmod(k - F.col("__i") - 1, 2 * F.col("__n"))
            at = F.when(at < F.col("__n"), at).otherwise(2 * F.col("__n") - 1 - at)
            own = F.when(F.col("__i") >= k, own).otherwise(F.get(F.col("__first"), at.cast("int"))["v"].cast("double"))
        total = total + own
    return rows.withColumn(name, total / n).select(*df.columns, name)
