"""The resume ledger: finished records as JSON lines, committed by batch, read back in spite of a record cut short.

A run's folder holds one folder a batch. A batch's folder is written whole or not at all and replaced if its batch is repeated, so
a record is there once however often a stream is restarted. A line that was being written when the machine stopped lacks its end;
it is told from a record by that, left out, and its clip is run again. The first record of a run is its configuration.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipflow.operators import manifest as A

CONFIG = "_config"


def commit(batch: DataFrame, batch_id: int, path: str) -> None:
    """The records of one batch, for ``foreachBatch``; a repeated batch replaces itself. Columns that are null are written as null."""
    batch.select(F.to_json(F.struct(*batch.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/batch={batch_id:010d}")


def commit_config(spark: SparkSession, config: dict, path: str) -> None:
    """The run's configuration as its first record."""
    spark.createDataFrame([(json.dumps({CONFIG: config}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/batch=config")


def stream(records: DataFrame, path: str, checkpoint: str):
    """A stream of finished records into the ledger."""
    return records.writeStream.foreachBatch(lambda b, i: commit(b, i, path)).option("checkpointLocation", checkpoint)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a ledger and whether each is whole: one JSON object up to its closing brace. A missing ledger is an empty one."""
    try:
        raw = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    # a map of raw values parses only if the object is closed; the brace is asked for too, since the parser forgives some ends
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return raw.where(F.trim("value") != "").select("value", (parsed.isNotNull() & F.rlike("value", F.lit(r"\}\s*$"))).alias("whole"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole records, the last of an id's if it has several (by batch, then text)."""
    held = lines(spark, path).where("whole").where(~F.contains(F.substring("value", 1, 32), F.lit(f'"{CONFIG}"')))
    return held.select(F.from_json("value", schema).alias("r")).select("r.*").where("id IS NOT NULL").dropDuplicates(["id"])


def config(spark: SparkSession, path: str) -> DataFrame | None:
    """key and value of the configuration that a ledger was begun with; None if it records none."""
    held = lines(spark, path).where("whole").where(F.contains(F.substring("value", 1, 32), F.lit(f'"{CONFIG}"')))
    first = held.select(F.from_json("value", f"{CONFIG} map<string,string>").alias("r")).limit(1)  # one record a run
    found = first.select(F.explode(f"r.{CONFIG}").alias("key", "value"))
    return found if not first.isEmpty() else None


def plan(manifest: DataFrame, spark: SparkSession, path: str, schema: str, wanted: DataFrame) -> DataFrame:
    """What is left of ``manifest``: id and action, which is refused for all if the ledger's configuration and ``wanted`` (key, value) differ in any key of either."""
    left = A.remaining(manifest, read(spark, path, schema)).select("id")
    saved = config(spark, path)
    if saved is None:
        return left.withColumn("action", F.lit("run"))
    differs = A.config_diff(saved, wanted).agg(F.count("*").alias("n"))  # one row
    return left.join(F.broadcast(differs)).select("id", F.when(F.col("n") > 0, "refused").otherwise("run").alias("action"))
