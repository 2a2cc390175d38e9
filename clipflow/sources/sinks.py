"""Sinks: sorted JSON lines, nested documents, partitioned landmarks and the log tee; the resume ledger is in ledger.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a run's outputs that are held as one JSON object, about: one longer text is still one.
PART_LETTERS = 4_000_000


def write_jsonl(df: DataFrame, path: str, by: str) -> None:
    """JSON lines; files and lines are in the order of ``by``."""
    df.orderBy(by).write.json(path, ignoreNullFields=False)


def write_runs(outputs: DataFrame, config: DataFrame, path: str) -> None:
    """JSON objects of a run, a line each: its configuration, and its outputs as an array. outputs: run, id and the other output columns; config: run, config map.

    A run of more than PART_LETTERS letters is dealt by id over several objects, all with its tag and configuration, so that none grows with the
    run; ``output_part`` counts them from 0.
    """
    names = [c for c in outputs.columns if c != "run"]
    texts = [f.name for f in outputs.schema if f.name != "run" and isinstance(f.dataType, T.StringType)]
    letters = sum((F.coalesce(F.length(n), F.lit(0)) for n in texts), F.lit(100)).cast("long")
    of = outputs.groupBy("run").agg(F.ceil(F.sum(letters) / PART_LETTERS).alias("parts")).join(config, "run")
    dealt = outputs.join(F.broadcast(of), "run").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))  # a row a run
    held = dealt.groupBy("run", "part").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("outputs"), F.first("config").alias("config"))
    doc = held.select(F.to_json(F.struct(F.col("run").alias("tag"), F.col("part").alias("output_part"), "outputs")).alias("a"), F.to_json("config").alias("b"))
    merged = F.when(F.col("b") == "{}", F.col("a")).otherwise(F.concat(F.expr("substring(a, 1, length(a) - 1)"), F.lit(","), F.expr("substring(b, 2, length(b))")))
    doc.select(merged.alias("value")).write.text(path)


def write_landmarks(df: DataFrame, path: str, clip: str = "clip") -> None:
    """Parquet partitioned by clip."""
    df.repartition(clip).write.partitionBy(clip).parquet(path)


def write_stats(df: DataFrame, path: str, clip: str = "clip") -> None:
    """JSON lines of each clip's frames in a folder of its own, beside its landmarks; the row with no frame holds the clip's largest counts."""
    counts = [c for c in df.columns if c not in (clip, "frame")]
    every = df.groupingSets([[F.col(clip), F.col("frame")], [F.col(clip)]], clip, "frame").agg(*(F.max(c).alias(c) for c in counts))
    every.repartition(clip).sortWithinPartitions(clip, F.col("frame").asc_nulls_last()).write.partitionBy(clip).json(path)


def tee(batch: DataFrame, full: str, transcript: str, prefix: str = "Signer: ") -> None:
    """All lines to one folder, those with the prefix to another."""
    batch.write.mode("append").text(full)
    batch.where(F.startswith("value", F.lit(prefix))).write.mode("append").text(transcript)
