"""Operators over landmark frames: nearest parts, fills, resampling, padding and pixel metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipflow.functions.boxes import MISSING, distance
from clipflow.operators.windows import filled, gap_filled


def points_of(values: str, n: int = 32) -> Column:
    """A flat array as ``n`` points [x, y]."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(F.get(values, 2 * i).cast("double"), F.get(values, 2 * i + 1).cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """``round`` that keeps the sign of a zero, as SQL's does: a small negative number becomes -0.0."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def subset(points: Column, ids: list[int]) -> Column:
    """The points of the given numbers; null where there is none."""
    return F.transform(F.array(*map(F.lit, ids)), lambda i: F.get(points, i))


def nearest(anchor: Column, candidates: Column, within: float | None = None, dims: int = 2) -> Column:
    """{d, i} of the candidate whose first point is nearest to the anchor, the first of equals; null beyond ``within``."""
    ranked = F.transform(candidates, lambda c, i: F.struct(distance(anchor, c[0], dims).alias("d"), i.alias("i")))
    best = F.array_min(ranked)
    return best if within is None else F.when(best["d"] < within, best)


def pose_filled(df: DataFrame, clip: str = "clip", frame: str = "frame", pose: str = "pose") -> DataFrame:
    """Every frame 0 to the last. A missing frame takes the last pose seen (MISSING if none yet); one that is there without a pose takes MISSING."""
    d = gap_filled(df.select(clip, frame, pose), clip, frame)
    value = F.when(F.col("present"), F.coalesce(pose, F.lit(MISSING)))
    d = d.withColumn("__value", value)
    last = filled("__value", [clip], [frame])
    return d.select(clip, frame, "present", F.coalesce(last, F.lit(MISSING)).alias(pose))


def long_form(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias("pos", "v"))


def pixel_metrics(df: DataFrame, clip: str, order: str, pixels: str, side: int = 8, block: int = 4, above: float = 8.0) -> DataFrame:
    """Between a frame and the one before it: mean absolute difference, median shift, share of pixels beyond the shift, strongest block, p99."""
    before = F.lag(pixels).over(W.partitionBy(clip).orderBy(order))
    diff = df.withColumn("__d", F.zip_with(pixels, before, lambda a, b: F.abs(a.cast("double") - b.cast("double")))).where("__d IS NOT NULL")
    d = long_form(diff, [clip, order], "__d")
    cell = F.floor(F.floor(F.col("pos") / side) / block) * side + F.floor((F.col("pos") % side) / block)
    by = [clip, order]
    blocks = d.groupBy(*by, cell.alias("cell")).agg(F.avg("v").alias("b")).groupBy(*by).agg(F.max("b").alias("block"))
    flat = d.groupBy(*by).agg(F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.99))).alias("p"), F.collect_list("v").alias("all"))  # side * side values
    pct = 100.0 * F.size(F.filter("all", lambda x: x - F.col("p")[0] > above)) / F.size("all")
    r = lambda c: F.round(c, 6)
    return flat.join(blocks, by).select(*by, r(F.col("mean")).alias("current"), r(F.col("p")[0]).alias("shift"), r(pct).alias("pct"), r(F.col("block")).alias("block"), r(F.col("p")[1]).alias("p99"))


def resampled(df: DataFrame, clip: str, frame: str, value: str, n: int = 128) -> DataFrame:
    """``n`` rows a clip: evenly picked frames of a longer one, all of a shorter one and then zeros. frame counts from 0 without gaps."""
    sizes = df.groupBy(clip).agg((F.max(frame) + 1).alias("__n"))
    slots = sizes.select(clip, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("slot"))
    source = F.when(F.col("__n") > n, F.floor(F.col("slot") * (F.col("__n") - 1) / (n - 1))).otherwise(F.col("slot"))
    return slots.withColumn(frame, source.cast("long")).join(df.select(clip, frame, value), [clip, frame], "left").select(clip, "slot", F.coalesce(value, F.lit(0.0)).alias(value))


def crop_sources(df: DataFrame, by: list[str], frame: str, landmarks: str, parts: list[str]) -> DataFrame:
    """For each frame and part, what its crop shows: adds {part}_crop, a struct of ``image`` (the frame that is cut) and ``box``; null: a blank.

    ``landmarks`` is a struct of ``pose`` (boolean) and a box for each part, and null where the whole frame was missed. Then the last frame's
    landmarks stand in, on this frame's image. A part that has no box, or a frame without a pose, keeps the part's last crop.
    """
    upto = W.partitionBy(*by).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("__now", F.last(landmarks, ignorenulls=True).over(upto))
    now = F.col("__now")
    fresh = lambda part: F.when(now["pose"] & now[part].isNotNull(), F.struct(F.col(frame).alias("image"), now[part].alias("box")))
    return d.withColumns({f"{part}_crop": F.last(fresh(part), ignorenulls=True).over(upto) for part in parts}).drop("__now")
