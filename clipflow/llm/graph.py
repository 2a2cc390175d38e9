"""Connected components of a graph of longs, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipflow.llm.common import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(root) if root else shared_dir(df.sparkSession, "checkpoint")
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Ask the driver's JVM to collect: Spark removes the shuffle files of plans nothing refers to any more only then, so those of an
    iteration would otherwise lie on the executors' disks until its heap fills."""
    df.sparkSession.sparkContext._jvm.System.gc()


def large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours under the least node around."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours under the least of them. Edges run from the smaller ``a`` to ``b``."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: longs a < b. Returns node, root: the least node of its component, for every node that has an edge.

    Alternates the two star steps until nothing changes; the rounds grow with the logarithm of the longest chain.
    """
    now = cut(edges.select("a", "b").distinct())
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = tuple(seen)
        now = cut(small_star(large_star(now)))
        release(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
