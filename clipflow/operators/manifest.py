"""Manifests, ledgers and configurations of evaluation runs."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ABSENT = "<not recorded>"


def remaining(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    return manifest.join(ledger.select("id"), "id", "left_anti")


def ordered_outputs(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger's records with their place in the manifest."""
    return manifest.select("id", "position").join(ledger, "id")


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Clips that both runs have: id, and each run's reference and hypothesis."""
    named = lambda d, r: d.select("id", F.col("reference").alias(f"reference_{r}"), F.col("hypothesis").alias(f"hypothesis_{r}"))
    return named(a, "a").join(named(b, "b"), "id")


def checked(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pairs`` of two runs that may be compared. Stops if they share no clip or if a shared clip has two references; warns where one run has clips that the other lacks."""
    found = pairs(a, b)
    both, differ = found.agg(F.count("*"), F.count_if(~F.col("reference_a").eqNullSafe(F.col("reference_b")))).first()
    if not both:
        raise ValueError("no clips in common")
    if differ:
        raise ValueError(f"{differ} clips have different references: the runs are not comparable")
    if (sizes := (a.count(), b.count())) != (both, both):
        warnings.warn(f"{sizes[0]} and {sizes[1]} clips, {both} shared: only those are compared", stacklevel=2)
    return found


def mismatches(pairs: DataFrame) -> DataFrame:
    """Shared clips whose references differ; a comparison is sound only if this is empty."""
    return pairs.where("reference_a <> reference_b").select("id", "reference_a", "reference_b")


def config_diff(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """key, value columns of two runs: the keys of either whose values differ; a key that a run lacks counts as ABSENT. ``by``: columns that tell many comparisons apart."""
    left, right = a.select(*by, "key", F.col("value").alias("a")), b.select(*by, "key", F.col("value").alias("b"))
    both = left.join(right, [*by, "key"], "full_outer").select(*by, "key", F.coalesce("a", F.lit(ABSENT)).alias("a"), F.coalesce("b", F.lit(ABSENT)).alias("b"))
    return both.where("a <> b")


def repair_guard(saved: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Differences over the keys of the saved run alone; a key that is wanted but was not saved is not compared."""
    return saved.select(*by, "key", F.col("value").alias("saved")).join(wanted.select(*by, "key", F.col("value").alias("wanted")), [*by, "key"]).where("saved <> wanted")


def repaired(outputs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Failed rows (blank hypothesis) patched from ``fixed`` (id, hypothesis); ``patched`` tells which."""
    f = fixed.select("id", F.col("hypothesis").alias("__new"))
    failed = F.trim("hypothesis") == ""
    patched = failed & F.col("__new").isNotNull()
    return outputs.join(f, "id", "left").withColumn("patched", patched).withColumn("hypothesis", F.when(F.col("patched"), F.col("__new")).otherwise(F.col("hypothesis"))).drop("__new")


def not_done(inputs: DataFrame, done: DataFrame, problems: DataFrame) -> DataFrame:
    """Inputs whose stem has no output and whose path is not on the problem list."""
    return inputs.join(done.select("stem"), "stem", "left_anti").join(problems.select("path"), "path", "left_anti")


def not_named(inputs: DataFrame, lines: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """Inputs whose path is no part of any line of a problem list. Null paths stay; an empty path is a part of any line.

    A line that holds a path holds the path's last letters at its end, so each line names all its pieces as long as the shortest path, and only
    pieces equal to a path's end are searched: an equality in place of all paths times all lines.
    """
    least = inputs.agg(F.min(F.length(path))).first()[0] or 0
    text = lines.select(F.col(line).alias("__line")).where("__line is not null")
    starts = F.sequence(F.lit(1), F.length("__line") - least + 1)
    pieces = text.where(F.length("__line") >= least).select("__line", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("__line", i, F.lit(least))))).alias("__end"))
    d = inputs.withColumn("__key", F.right(path, F.lit(least)))
    return d.join(pieces, (d["__key"] == pieces["__end"]) & F.contains(pieces["__line"], d[path]), "left_anti").drop("__key")


def subset(rows: DataFrame, available: Column, videos: int = 6, clips: int = 60, least: float = 0.8) -> DataFrame:
    """A bounded subset of annotations: yid, start (text), end, start_s, end_s, first (the video's first place).

    Videos are taken by falling sentence count (first seen first) until ``videos`` available ones or ``clips`` clips. In a video
    sentences go by their start as text; the number in an id counts those that are too short as well.
    """
    sizes = rows.withColumn("__ok", available).groupBy("yid").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min("__ok").alias("ok"))
    taken = sizes.where("ok").orderBy(F.desc("n"), "first").limit(videos)  # ``videos`` rows
    ranked = taken.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "first"))).select("yid", "rank")
    d = rows.join(F.broadcast(ranked), "yid").withColumn("i", F.row_number().over(W.partitionBy("yid").orderBy("start", "first")))
    long = d.where(F.col("end_s") - F.col("start_s") >= least).orderBy("rank", "i").limit(clips)
    return long.select(F.format_string("%s_%02d", "yid", "i").alias("id"), "yid", F.round(F.col("end_s") - F.col("start_s"), 2).alias("seconds"))


def vocabulary(labels: DataFrame, label: str) -> DataFrame:
    """Distinct trimmed labels and their place in sorted order, from 0. The window runs over the distinct labels."""
    d = labels.select(F.trim(label).alias("label")).where("label <> ''").distinct()
    return d.select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("long").alias("ix"))
