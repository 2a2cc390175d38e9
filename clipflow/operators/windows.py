"""Window operators over frames ordered within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SESSION, ORDER = ["session_id"], ["idx"]


def over(by: list[str] = SESSION, order: list[str] = ORDER, rows: tuple[int, int] | None = None):
    w = W.partitionBy(*by).orderBy(*order)
    return w.rowsBetween(*rows) if rows else w


def indexed(df: DataFrame, by: list[str], order: list[str], out: str = "idx") -> DataFrame:
    """0, 1, ... within each group."""
    return df.withColumn(out, F.row_number().over(over(by, order)).cast("long") - 1)


def strided(df: DataFrame, stride: int = 2) -> DataFrame:
    """Every ``stride``-th frame, counted from the session's first."""
    if stride < 1:
        raise ValueError("stride must be 1 or more")
    return df.where(F.pmod("idx", F.lit(stride)) == 0)


def smoothed(df: DataFrame, frames: int = 15, by: list[str] = SESSION, score: str = "score", out: str = "smoothed") -> DataFrame:
    """Mean of the last ``frames`` scores, of fewer at the start; rounded so that thresholds compare alike everywhere."""
    return df.withColumn(out, F.round(F.avg(score).over(over(by, rows=(1 - frames, 0))), 6))


def phase_spans(df: DataFrame) -> DataFrame:
    """Adds span: the number, from 0, of the run of equal phases that a frame lies in."""
    changed = F.when(F.col("phase").eqNullSafe(F.lag("phase").over(over())), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn("span", F.sum("__changed").over(over(rows=(W.unboundedPreceding, 0))) - 1).drop("__changed")


def debounced(score: str, above: float, frames: int, by: list[str] = SESSION) -> Column:
    """True where this and the frames before it, ``frames`` in all, are strictly above."""
    w = over(by, rows=(1 - frames, 0))
    return (F.min(score).over(w) > above) & (F.count(F.lit(1)).over(w) == frames)


def k_of_n(hit: Column, k: int, n: int) -> Column:
    """True where at least ``k`` of the last ``n`` frames are hits; a null hit is none."""
    return F.sum(F.when(hit, 1).otherwise(0)).over(over(rows=(1 - n, 0))) >= k


def runs(df: DataFrame, on: Column, by: list[str] = SESSION) -> DataFrame:
    """The maximal runs of consecutive frames where ``on`` holds: run_start, run_end, frames."""
    held = df.withColumn("__on", on).withColumn("__rn", F.row_number().over(over(by)))
    island = held.where("__on").withColumn("__island", F.col("__rn") - F.row_number().over(over(by)))
    return island.groupBy(*by, "__island").agg(F.min("idx").alias("run_start"), F.max("idx").alias("run_end"), F.count("*").alias("frames")).drop("__island")


def frame_diff(values: str, by: list[str], order: list[str]) -> Column:
    """Mean absolute difference of an array and the one before it; 0 on the first frame and where the lengths differ."""
    before = F.lag(values).over(W.partitionBy(*by).orderBy(*order))
    total = F.aggregate(F.zip_with(values, before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(before.isNull() | (F.size(before) != F.size(values)), 0.0).otherwise(F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0)))


def displacement(points: str, by: list[str], order: list[str]) -> Column:
    """Mean distance that (x, y) points moved since the frame before; 0 if their number changed."""
    before = F.lag(points).over(W.partitionBy(*by).orderBy(*order))
    step = F.zip_with(points, before, lambda p, q: F.sqrt(F.pow(p[0] - q[0], 2) + F.pow(p[1] - q[1], 2)))
    return F.when(before.isNull() | (F.size(before) != F.size(points)), 0.0).otherwise(F.coalesce(F.try_divide(F.aggregate(step, F.lit(0.0), lambda s, x: s + x), F.size(points)), F.lit(0.0)))


def filled(value: str, by: list[str] = SESSION, order: list[str] = ORDER) -> Column:
    """The last value seen up to this frame."""
    return F.last(value, ignorenulls=True).over(over(by, order, (W.unboundedPreceding, 0)))


def filled_with_limit(df: DataFrame, value: str, out: str, misses: int = 5) -> DataFrame:
    """Carry the last value for up to ``misses`` frames without one; 0 beyond, and before the first."""
    seen = F.last(F.when(F.col(value).isNotNull(), F.col("idx")), ignorenulls=True).over(over(rows=(W.unboundedPreceding, 0)))
    gap = F.col("idx") - seen
    return df.withColumn(out, F.when(gap <= misses, filled(value)).otherwise(F.lit(0.0)))


def rolling_rate(seconds: str, frames: int = 30, by: list[str] = SESSION) -> Column:
    """One over the mean of the last frame times."""
    return F.try_divide(F.lit(1.0), F.avg(seconds).over(over(by, rows=(1 - frames, 0))))


def gap_filled(df: DataFrame, by: str, idx: str) -> DataFrame:
    """A row for every frame number from 0 to the group's last; ``present`` tells which were there."""
    ends = df.groupBy(by).agg(F.max(idx).alias("__last"))
    every = ends.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last").cast("long"))).alias(idx))
    return every.join(df.withColumn("present", F.lit(True)), [by, idx], "left").withColumn("present", F.coalesce("present", F.lit(False)))
