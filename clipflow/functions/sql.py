"""Text metrics as SQL functions of a session. Their bodies are SQL, so plans that call them stay native."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "char_similarity": "(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN a = b THEN 1.0D WHEN length(a) = 0 OR length(b) = 0 THEN 0.0D ELSE 1.0D - levenshtein(a, b) / greatest(length(a), length(b)) END",
    "hhmmss_to_seconds": "(s STRING) RETURNS DOUBLE RETURN cast(split_part(s, ':', 1) AS DOUBLE) * 3600 + cast(split_part(s, ':', 2) AS DOUBLE) * 60 + cast(split_part(s, ':', 3) AS DOUBLE)",
    "path_stem": r"(s STRING) RETURNS STRING RETURN regexp_replace(regexp_extract(s, r'([^/]*)$', 1), r'\.[^.]*$', '')",
}


def register(spark: SparkSession, prefix: str = "") -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
