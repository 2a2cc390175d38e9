"""The driver's tables in the roles of the data model: events as frames, documents as clips with references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipflow.operators.windows import indexed

HOUR = 3_600_000_000
LABELS = {"view": "STAND STILL", "error": "MOVE (NO SIGNING)", "click": "SIGN", "purchase": "FINGERSPELL"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, idx, event_id, t (microseconds), score, phase, present, k, label."""
    df = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("score"), F.col("event_type").alias("phase"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("present"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    label = F.lit("RIGHT ARM")
    for phase, name in LABELS.items():
        label = F.when(F.col("phase") == phase, name).otherwise(label)
    return indexed(df.withColumn("label", label), ["session_id"], ["t", "event_id"])


FRAMES = """frames AS (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  epoch_us(ts) AS t, value AS score, event_type AS phase, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS present, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE event_type WHEN 'view' THEN 'STAND STILL' WHEN 'error' THEN 'MOVE (NO SIGNING)' WHEN 'click' THEN 'SIGN' WHEN 'purchase' THEN 'FINGERSPELL' ELSE 'RIGHT ARM' END AS label FROM events)"""
SMOOTH = FRAMES + """, sm AS (SELECT *, round(avg(score) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM frames)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, reference (all words), hyp_a and hyp_b (every 7th and every 11th word left out)."""
    words = F.filter(F.split(F.regexp_replace("text", r"^\s+", ""), r"\s+"), lambda w: w != "")
    # a file may hold all texts in one row group: deal the rows evenly before the work on each of them
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    df = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), words.alias("w"))
    without = lambda k: F.array_join(F.filter("w", lambda w, i: (F.col("id") + i) % k != 0), " ")
    return df.select("id", "category", F.array_join("w", " ").alias("reference"), without(7).alias("hyp_a"), without(11).alias("hyp_b"))


CLIPS = r"""words AS (SELECT doc_id AS id, lang AS category, (list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM documents),
clips AS (SELECT id, category, array_to_string(w, ' ') AS reference,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: (id + i - 1) % 7 <> 0), lambda i: w[i]), ' '), '') AS hyp_a,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: (id + i - 1) % 11 <> 0), lambda i: w[i]), ' '), '') AS hyp_b FROM words)"""
