"""Latest only: of the items that wait for a slow consumer the newest wins, over any number of micro-batches.

Each batch leaves one row a key, its newest, in a folder of its own that a repeated batch replaces. Readers take the newest over all
folders, so neither a batch run twice nor batches in another order change the answer. ``compact`` folds finished batches into one
folder, which keeps the number of rows at one a key and open batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("t", "idx")) -> DataFrame:
    """One row a key: the greatest by ``order``; all its other columns. Added up in each task before the shuffle."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def upsert(batch: DataFrame, batch_id: int, path: str, **by) -> None:
    """For ``foreachBatch``: the batch's newest rows, written under its number."""
    newest(batch, **by).write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")


def read(spark: SparkSession, path: str, schema: str, **by) -> DataFrame:
    """The newest row of each key over all batches."""
    held = spark.read.schema(f"{schema}, batch string").parquet(path)
    return newest(held.drop("batch"), **by)


def compact(spark: SparkSession, path: str, schema: str, to: str, **by) -> None:
    """The newest of all batches as one batch of a new folder ``to``."""
    read(spark, path, schema, **by).write.mode("overwrite").parquet(f"{to}/batch=base")


def run(source: DataFrame, path: str, checkpoint: str, **by) -> None:
    """Take up all that waits in a streaming ``source``."""
    q = source.writeStream.foreachBatch(lambda b, i: upsert(b, i, path, **by)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
