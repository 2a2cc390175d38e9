"""Readers of frame logs, manifests, runs, annotations, prompts, label tables, landmarks and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from clipflow import schemas


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A frame log, one JSON object a line. Order is by t, then idx: line numbers are not kept."""
    return spark.read.schema(schemas.FRAMES).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each id; blank lines are skipped, a line that is no record fails the read."""
    try:
        rows = spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no manifest at {path}") from error
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("line")))
    return rows.where("id IS NOT NULL").withColumn("__last", last).where("__last = 1").drop("__last")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation runs, one JSON object each or several numbered by ``output_part``: (run, outputs exploded) and (run, open configuration as a map)."""
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json("value", f"tag string, output_part long, outputs array<struct<{schemas.OUTPUT.replace(' string', ':string').replace(' double', ':double')}>>").alias("r"))
    outputs = parsed.select(F.col("r.tag").alias("run"), F.inline("r.outputs"))
    own = F.from_json("value", "tag string, output_part long").alias("r"), F.from_json("value", "map<string,string>").alias("all")
    # every part holds the configuration: that of the least one counts
    least = raw.select(*own).select(F.col("r.tag").alias("run"), F.coalesce("r.output_part", F.lit(0)).alias("part"), F.map_filter("all", lambda k, v: ~k.isin("outputs", "results", "tag", "output_part")).alias("config"))
    config = least.groupBy("run").agg(F.min_by("config", "part").alias("config"))
    return outputs, config


def read_annotations(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Tab-separated annotations of one split."""
    rows = spark.read.schema(schemas.ANNOTATIONS).csv(path, sep="\t", header=True, quote='"', escape='"')
    return rows.where(F.col("split") == split)


def read_hand_presence(spark: SparkSession, path: str) -> DataFrame | None:
    """Per frame: idx and present (some hand was seen). None where there is no such file: rows that need it are left out."""
    try:
        rows = spark.read.schema("i long, n_hands int").json(path)
    except AnalysisException:
        return None
    return rows.where("i IS NOT NULL").select(F.col("i").alias("idx"), (F.col("n_hands") > 0).alias("present"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt lines ``category<TAB>sentence``; blank lines, comments and empty sentences go. Numbered in line order: a prompt file is one small file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    kept = lines.where(~F.trim("value").startswith("#") & F.contains("value", F.lit("\t")))
    parts = kept.select("line", F.regexp_extract("value", r"^([^\t]*)\t(.*)$", 1).alias("category"), F.trim(F.regexp_extract("value", r"^([^\t]*)\t(.*)$", 2)).alias("sentence")).where("sentence <> ''")
    number = F.row_number().over(W.orderBy("line"))
    return parts.select(F.format_string("%03d", number).alias("id"), "category", "sentence")


def read_glosses(spark: SparkSession, path: str) -> DataFrame:
    """The third column of a label table with a header."""
    return spark.read.schema("a string, b string, gloss string").csv(path, header=True).select(F.trim("gloss").alias("gloss"))


def read_stream_paths(spark: SparkSession, path: str) -> DataFrame:
    """Lists whose first field holds four tab-joined paths."""
    p = F.split(F.col("first"), "\t")
    return spark.read.schema("first string, rest string").csv(path).select(*(F.get(p, i).alias(n) for i, n in enumerate(("face", "left_hand", "right_hand", "pose"))))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects {clip, frames: {"0": landmarks or null, ...}}: one row a frame."""
    raw = spark.read.schema(f"clip long, frames map<string,{schemas.LANDMARK}>").json(path)
    return raw.select("clip", F.explode("frames").alias("key", "landmarks")).select("clip", F.col("key").cast("int").alias("frame"), "landmarks")


def list_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """Path and length of the files of a pattern under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Usable calibration profiles: readable, and with a start threshold other than 0."""
    rows = spark.read.schema(schemas.PROFILE).option("mode", "DROPMALFORMED").json(path)
    return rows.where("start_threshold IS NOT NULL AND start_threshold <> 0")
