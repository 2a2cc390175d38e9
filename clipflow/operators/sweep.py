"""Sweep line over intervals, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def most_at_once(df: DataFrame, start: str, end: str, weights: dict[str, Column], bins: int = 1024) -> DataFrame:
    """The highest running total of each weight, added at ``start`` and taken away at ``end`` (together, where times are equal).

    Times are cut into ``bins`` equal ranges. A range's net change is one row, so the totals before each range come from ``bins`` rows;
    inside a range the running sums are windows of that range.
    """
    names = list(weights)
    up = df.select(F.col(start).alias("t"), *(w.cast("long").alias(n) for n, w in weights.items()))
    down = df.select(F.col(end).alias("t"), *((-w).cast("long").alias(n) for n, w in weights.items()))
    net = up.union(down).groupBy("t").agg(*(F.sum(n).alias(n) for n in names))
    ends = net.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    placed = net.crossJoin(F.broadcast(ends)).withColumn("bin", F.floor((F.col("t") - F.col("a")) * bins / (F.col("b") - F.col("a") + 1)).cast("int"))
    sums = placed.groupBy("bin").agg(*(F.sum(n).alias(f"{n}_net") for n in names))
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # over the ranges, not over the rows
    starts = sums.select("bin", *(F.coalesce(F.sum(f"{n}_net").over(before), F.lit(0)).alias(f"{n}_before") for n in names))
    inside = W.partitionBy("bin").orderBy("t")
    return placed.join(F.broadcast(starts), "bin").select(*((F.sum(n).over(inside) + F.col(f"{n}_before")).alias(n) for n in names)).agg(*(F.max(n).alias(n) for n in names))
