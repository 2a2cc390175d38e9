"""Comparison of two runs over the same clips. Input: id, category, run ('a' or 'b'), hyp, ref."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipflow.operators import textmetrics as M
from clipflow.sources.shared import shared_dir


def compared(runs: DataFrame) -> DataFrame:
    """Per category and overall (ALL): each metric of both runs and their difference."""
    stats = M.all_stats(runs, ["category", "run"], "hyp", "ref", F.lit(True))
    sets = stats.groupingSets([[F.col("run")], [F.col("category"), F.col("run")]], "category", "run")
    total = sets.agg(*(F.sum(n).alias(n) for n in M.BLEU + M.CHRF), F.grouping("category").alias("all"))
    metrics = F.create_map(F.lit("bleu_raw"), F.round(M.bleu(), 4), F.lit("chrf"), F.round(M.chrf(), 4))
    each = total.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("category")).alias("category"), "run", F.explode(metrics).alias("metric", "v"))
    wide = each.groupBy("category", "metric").agg(*(F.max(F.when(F.col("run") == r, F.col("v"))).alias(r) for r in "ab"))
    return wide.select("category", "metric", "a", "b", F.round(F.col("b") - F.col("a"), 4).alias("delta"))


def speeds(runs: DataFrame, millis: str = "millis") -> DataFrame:
    """Per category and overall (ALL): mean seconds a clip of both runs, and how many times faster b is. Clips without a time don't count.

    Times are whole milliseconds, so sums do not depend on their order. A run without times has null; so has a ratio to no time at all.
    """
    sets = runs.groupingSets([[F.col("run")], [F.col("category"), F.col("run")]], "category", "run")
    each = sets.agg(F.sum(millis).alias("ms"), F.count(millis).alias("n"), F.grouping("category").alias("all"))
    named = each.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("category")).alias("category"), "run", F.try_divide("ms", F.col("n") * 1000).alias("mean"))
    wide = named.groupBy("category").agg(*(F.max(F.when(F.col("run") == r, F.col("mean"))).alias(r) for r in "ab"))
    return wide.select("category", F.round("a", 4).alias("seconds_a"), F.round("b", 4).alias("seconds_b"), F.round(F.try_divide("a", "b"), 4).alias("speed_up"))


def recalls(nouns: DataFrame) -> DataFrame:
    """nouns: run, best (similarity of each reference noun). The share found exactly in both runs, in hundredths, and the difference; no row unless both have nouns."""
    share = lambda r: F.try_divide(100.0 * F.count_if((F.col("run") == r) & (F.col("best") == 1)), F.count_if(F.col("run") == r))
    both = nouns.agg(share("a").alias("a"), share("b").alias("b")).where("a is not null and b is not null")
    return both.select(F.lit("proper_noun_recall").alias("metric"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(F.col("b") - F.col("a"), 4).alias("delta"))


def paired(stats: DataFrame) -> DataFrame:
    """One row per clip: the BLEU statistics of both runs as a_... and b_..."""
    return stats.groupBy("id").agg(*(F.max(F.when(F.col("run") == r, F.col(n))).alias(f"{r}_{n}") for r in "ab" for n in M.BLEU))


def of(run: str, f=F.col):
    return lambda n: f(f"{run}_{n}")


def gains(runs: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """id and gain in sentence BLEU from a to b of the clips whose text changed. ``stats``: what ``paired`` gives for the runs, where it is at hand."""
    changed = runs.groupBy("id").agg(F.max(F.when(F.col("run") == "a", F.col("hyp"))).alias("x"), F.max(F.when(F.col("run") == "b", F.col("hyp"))).alias("y")).where("x <> y").select("id")
    p = (paired(M.bleu_stats(runs, ["id", "run"], "hyp", "ref")) if stats is None else stats).join(changed, "id", "left_semi")
    a, b = (F.round(M.bleu(of(r), effective=True), 6) for r in "ab")
    return p.select("id", F.round(b - a, 4).alias("gain"))


def without_winners(runs: DataFrame, drops: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """The difference of corpus BLEU without the clips that gained most. Texts are counted and sums taken once; the winners' share is subtracted."""
    once, path = paired(M.bleu_stats(runs, ["id", "run"], "hyp", "ref")), shared_dir(runs.sparkSession, "stats")
    once.write.parquet(path)
    stats = runs.sparkSession.read.schema(once.schema).parquet(path)
    names = [f"{r}_{n}" for r in "ab" for n in M.BLEU]
    total = stats.agg(*(F.sum(n).alias(n) for n in names))
    top = gains(runs, stats).orderBy(F.desc("gain"), F.desc("id")).limit(max(drops))
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("gain"), F.desc("id")))).join(stats, "id")  # max(drops) rows
    grid = ranked.select("rank", *names, F.explode(F.array(*map(F.lit, drops))).alias("drop_n"))
    lost = grid.groupBy("drop_n").agg(*(F.sum(F.when(F.col("rank") <= F.col("drop_n"), F.col(n)).otherwise(0)).alias(f"x_{n}") for n in names), F.max("rank").alias("changed")).where("changed >= drop_n")
    rest = lost.join(F.broadcast(total)).select("drop_n", *((F.col(n) - F.col(f"x_{n}")).alias(n) for n in names))
    return rest.select(F.col("drop_n").cast("long").alias("drop_n"), F.round(M.bleu(of("b")) - M.bleu(of("a")), 4).alias("delta"))


#: Rounds of the 32-bit mix that draws from (clip, resample); shifts and odd factors under 2 ** 31, so that products fit a long.
ROUNDS, STEP = ((16, 0x21F0AAAD), (15, 0x735A2D97)), 0x9E3779B1
#: A clip's count in a resample is the number of these that its draw reaches: the distribution of Poisson(1), times 2 ** 32.
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(13)]


def counts_of(key: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """resamples x clips: how often each clip is in each resample. key: below 2 ** 32."""
    x = (key[None].astype(np.uint64) + np.arange(resamples, dtype=np.uint64)[:, None] * np.uint64(STEP) + np.uint64(seed)) % np.uint64(1 << 32)
    for shift, factor in ROUNDS:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor) % np.uint64(1 << 32)
    return np.searchsorted(np.array(POISSON, np.uint64), x.ravel(), "right").reshape(x.shape)


def paired_bootstrap(runs: DataFrame, resamples: int = 2000, seed: int = 7, metrics: tuple[str, ...] = ("bleu_raw", "bleu", "chrf")) -> DataFrame:
    """Per metric: the difference of both runs, a 95 % interval of it over resamples of the clips and P(d <= 0).

    bleu_raw is of the texts as they are, bleu and chrf of those with numbers normalised. A clip's count in a resample is a Poisson(1)
    number that depends on clip and resample alone. Each task adds up its clips' statistics for all resamples, so nothing is joined
    and ``resamples`` rows a task are shuffled, whatever the number of clips.
    """
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("hyp").alias("hyp"), F.col("ref").alias("ref")), F.struct(F.lit("numbers").alias("kind"), "hyp", "ref"))
    numbers = F.col("kind") == "numbers"
    stats = M.all_stats(runs.select("id", "run", F.inline(kinds)), ["id", "run", "kind"], "hyp", "ref", chars=numbers, numbers=numbers)
    columns = {f"{r}_{k}_{n}": (r, k, n) for r in "ab" for k, ns in (("raw", M.BLEU), ("numbers", M.BLEU + M.CHRF)) for n in ns}
    key = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long").alias("key")
    wide = stats.groupBy("id").agg(*(F.sum(F.when((F.col("run") == r) & (F.col("kind") == k), F.col(n))).alias(c) for c, (r, k, n) in columns.items()))
    names = list(columns)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((resamples, len(names))), 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.column_stack([np.asarray(part.column(n).fill_null(0), float) for n in names])
                total += counts_of(np.asarray(part.column("key")), resamples, seed) @ x  # whole numbers, exact in doubles
                seen += part.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int32()), *(pa.array(c.astype(np.int64)) for c in total.T)], names=["r", *names])

    draws = wide.select(key, *names).mapInArrow(summed, "r int, " + ", ".join(f"{n} long" for n in names)).groupBy("r").agg(*(F.sum(n).alias(n) for n in names))
    both = draws.union(wide.agg(F.lit(-1).alias("r"), *(F.sum(n).alias(n) for n in names)))  # r = -1: all clips once
    of_kind = lambda r, k: lambda n: F.col(f"{r}_{k}_{n}")
    values = {"bleu_raw": lambda r: M.bleu(of_kind(r, "raw")), "bleu": lambda r: M.bleu(of_kind(r, "numbers")), "chrf": lambda r: M.chrf(of_kind(r, "numbers"))}
    each = both.select("r", F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.round(values[m]("b") - values[m]("a"), 6))))).alias("metric", "d"))
    resampled = F.col("r") >= 0
    deltas = each.groupBy("metric").agg(F.max(F.when(~resampled, F.col("d"))).alias("delta"), F.sort_array(F.collect_list(F.when(resampled, F.col("d")))).alias("l"))  # one number per resample
    at = lambda p: F.round(F.element_at("l", F.floor(p * F.size("l")).cast("int") + 1), 4)
    return deltas.select("metric", F.round("delta", 4).alias("delta"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), (F.size(F.filter("l", lambda x: x <= 0)) / F.size("l")).alias("p_le_0"))
