"""Threshold fits from labelled frames. Labels are free text in capitals; three prefixes mark the negative class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipflow.functions.quantiles import linear, picked
from clipflow.operators.windows import over

#: Fixed values of the fits.
NEGATIVE, STILL = "^(STAND STILL|SIT STILL|MOVE)", "^(STAND STILL|SIT STILL)"
SEPARATION, STOP_RATIO = 1.30, 6.0


def is_negative(phase: str = "phase") -> Column:
    return F.upper(phase).rlike(NEGATIVE)


def is_still(phase: str = "phase") -> Column:
    return F.upper(phase).rlike(STILL)


def settled(df: DataFrame, settle: int) -> DataFrame:
    """Positive spans without their first ``settle`` frames, and without those that are no longer than that; others whole. Needs span."""
    by = ["session_id", "span"]
    d = df.withColumns({"__rn": F.row_number().over(over(by)), "__n": F.count("*").over(W.partitionBy(*by))})
    return d.where(is_negative() | ((F.col("__rn") > settle) & (F.col("__n") > settle))).drop("__rn", "__n")


def event_peaks(df: DataFrame, above: Column, gap: int, by: list[str], score: str = "score") -> DataFrame:
    """The highest score of each event: frames above, fewer than ``gap`` frames below between them. Needs rn, the frame's place in its group."""
    up = df.where(above)
    step = F.col("rn") - F.lag("rn").over(over(by, ["rn"])) - 1
    event = up.withColumn("__new", F.when(step.isNull() | (step >= gap), 1).otherwise(0)).withColumn("event", F.sum("__new").over(over(by, ["rn"], (W.unboundedPreceding, 0))))
    return event.groupBy(*by, "event").agg(F.max(score).alias("peak"))


def distribution(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per phase and metric: p50, p90, p95, p99 and max."""
    long = by_metric(df, metrics, F.col("phase"))
    top = long.groupBy("phase", "metric").agg(F.round(F.max("v"), 6).alias("max"))
    p = picked(long, ["phase", "metric"], "v", {n: (q, "linear") for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))})
    return p.select("phase", "metric", *(F.round(n, 6).alias(n) for n in ("p50", "p90", "p95", "p99"))).join(top, ["phase", "metric"])


def by_metric(df: DataFrame, metrics: list[str], *others: Column) -> DataFrame:
    """One row a frame and metric: the other columns, metric and its value v."""
    return df.select(*others, F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in metrics)), F.array(*(F.col(m) for m in metrics)))).alias("metric", "v"))


def separation(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric: negative p99, positive p10, their ratio and a verdict. A class without rows counts as one zero."""
    long = by_metric(df, metrics, is_negative().alias("neg"))
    names = df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    side = lambda on, name, p: picked(long.where(on), ["metric"], "v", {name: (p, "linear")})
    q = names.join(side(F.col("neg"), "n", 0.99), "metric", "left").join(side(~F.col("neg"), "p", 0.1), "metric", "left").na.fill(0.0)
    ratio = F.try_divide("p", "n")
    return q.select("metric", F.round("n", 6).alias("negative_p99"), F.round("p", 6).alias("positive_p10"), F.round(ratio, 6).alias("margin"), F.coalesce(ratio > 1, F.lit(False)).alias("separable"))


def fit(df: DataFrame, gap: int, by: list[str]) -> DataFrame:
    """Start and stop thresholds of each group, or why there are none.

    df: smoothed and settled frames with phase, score and rn (place among the group's positive frames, in order). Where some event
    clears the highest negative score: start = sqrt(neg_max * weakest), weakest the tenth percentile of event peaks, stop a sixth.
    Where none does and positives do not rise SEPARATION above stillness either, the fit is refused; else a pair from stillness and
    positives is given that needs the presence gate.
    """
    neg, still = is_negative(), is_still()
    stats = df.groupBy(*by).agg(
        F.max(F.when(neg, F.col("score"))).alias("neg_max"), linear("score", 0.5, neg).alias("neg_p50"), F.max(F.when(still, F.col("score"))).alias("still_max"),
        F.max(F.when(~neg, F.col("score"))).alias("pos_max"), linear("score", 0.5, still).alias("still_p50"), linear("score", 0.5, ~neg).alias("pos_p50"),
    )
    positive = df.where(~neg).join(stats.select(*by, "neg_max"), by)
    peaks = event_peaks(positive, F.col("score") > F.col("neg_max"), gap, by).groupBy(*by).agg(F.count("*").alias("events"), linear("peak", 0.1).alias("weakest"))
    s = stats.join(peaks, by, "left")
    clear = F.col("weakest").isNotNull()
    ratio = F.try_divide("weakest", "neg_max")
    refused = F.col("pos_max") <= SEPARATION * F.col("still_max")
    status = (
        F.when(clear & (ratio >= SEPARATION), "ok").when(clear, "weak").when(F.col("pos_max").isNull() | F.col("still_max").isNull(), "no_data")
        .when(refused & (F.col("still_max") >= 0.8 * F.col("neg_max")), "contaminated_still").when(refused, "retry").otherwise("hand_gated")
    )
    start = F.when(clear, F.sqrt(F.col("neg_max") * F.col("weakest"))).when(status == "hand_gated", F.sqrt(F.col("still_max") * F.col("pos_max")))
    stop = F.when(clear, F.sqrt(F.col("neg_max") * F.col("weakest")) / STOP_RATIO).when(status == "hand_gated", F.sqrt(F.col("still_p50") * F.col("pos_p50")))
    r = lambda c: F.round(c, 6)
    return s.select(
        *by, status.alias("status"), r(F.col("neg_max")).alias("neg_max"), r(F.col("neg_p50")).alias("neg_p50"), r(F.col("still_max")).alias("still_max"), r(F.col("pos_max")).alias("pos_max"),
        F.coalesce("events", F.lit(0)).alias("events"), r(F.col("weakest")).alias("weakest"), r(ratio).alias("separation"), r(start).alias("start"), r(stop).alias("stop"),
    )


def short_fit(df: DataFrame, by: list[str], neg_q: float, pos_q: float, margin: float = 1.05) -> DataFrame:
    """A quantile pair: start between them by geometric mean, or just above the negative one if they are not separated."""
    q = df.groupBy(*by).agg(linear("score", neg_q, is_negative()).alias("n"), linear("score", pos_q, ~is_negative()).alias("p"))
    start = F.when(F.col("p") <= F.col("n"), F.col("n") * margin).otherwise(F.sqrt(F.col("n") * F.col("p")))
    return q.select(*by, F.round("n", 6).alias("neg_hi"), F.round("p", 6).alias("pos_hi"), F.round(start, 6).alias("start"))


def sliding(df: DataFrame, step: int, size: int, by: list[str]) -> DataFrame:
    """The windows of ``size`` frames that begin every ``step`` frames, short at the end only if there is no other: adds w, the window's number."""
    d = df.withColumns({"__rn": F.row_number().over(over(by)) - 1, "__n": F.count("*").over(W.partitionBy(*by))})
    last = F.greatest(F.floor((F.col("__n") - size - 1) / step), F.lit(0))
    first = F.greatest(F.floor((F.col("__rn") - size) / step) + 1, F.lit(0))
    to = F.least(F.floor(F.col("__rn") / step), last)
    return d.where(first <= to).withColumn("w", F.explode(F.sequence(first, to))).drop("__rn", "__n")


def grid(df: DataFrame, pairs: list[tuple[float, float]], signing: tuple[str, ...], steps: tuple[int, int] = (8, 10), sizes: tuple[int, int] = (16, 20)) -> DataFrame:
    """Per quantile pair: the short fits of every pair of a negative and a positive window of a session, and how their starts do.

    A start's frames above it are counted in one pass: starts and frames of a session in one falling order of value, with running
    counts, instead of each start against each frame.
    """
    f = df.withColumn("neg", is_negative())
    qs = [sorted({p[i] for p in pairs}) for i in (0, 1)]
    side = lambda on, i, n: sliding(f.where(on), steps[i], sizes[i], ["session_id"]).groupBy("session_id", "w").agg(F.percentile("score", F.array(*map(F.lit, qs[i]))).alias(n))
    both = side(F.col("neg"), 0, "nq").drop("w").join(side(~F.col("neg"), 1, "pq").drop("w"), "session_id")
    rows = F.array(*(F.struct(F.lit(a).alias("neg_q"), F.lit(b).alias("pos_q"), F.lit(qs[0].index(a)).alias("i"), F.lit(qs[1].index(b)).alias("j")) for a, b in pairs))
    n, p = F.expr("nq[i]"), F.expr("pq[j]")
    starts = both.select("session_id", "nq", "pq", F.inline(rows)).select("session_id", "neg_q", "pos_q", F.round(F.when(p <= n, n * 1.05).otherwise(F.sqrt(n * p)), 6).alias("v"))
    frame = f.select("session_id", F.col("score").alias("v"), F.col("phase").isin(*signing).cast("int").alias("sign"), F.col("neg").cast("int").alias("neg"))
    every = starts.unionByName(frame, allowMissingColumns=True)
    down = W.partitionBy("session_id").orderBy(F.desc("v"), F.col("sign").isNotNull()).rowsBetween(W.unboundedPreceding, 0)  # a start before frames of its own value
    above = lambda c: F.coalesce(F.sum(c).over(down), F.lit(0))
    counted = every.withColumns({"__sign": above("sign"), "false_frames": above("neg"), "__all": F.sum("sign").over(W.partitionBy("session_id"))}).where("sign IS NULL")
    # millionths as whole numbers: the order of addition can't move their average across a rounding tie
    judged = counted.withColumn("coverage", F.round(F.try_divide(100000000.0 * F.col("__sign"), "__all"), 0).cast("long"))
    return judged.groupBy("neg_q", "pos_q").agg(
        F.count("*").alias("windows"), F.round(F.median("v"), 6).alias("start_median"), F.round(F.stddev_pop("v"), 4).alias("start_stdev"), exact(F.sum("coverage"), F.count("coverage"), 100).alias("coverage"),
        exact(F.sum("false_frames") * 10000, F.count("false_frames"), 1).alias("false_frames"), exact(F.count_if(F.col("false_frames") == 0) * 1000000, F.count("*"), 1).alias("clean_pct"),
    )


def exact(total: Column, n: Column, unit: int) -> Column:
    """``total`` / ``n`` / ``unit`` in whole numbers, half up, as ten-thousandths."""
    den = 2 * n * unit
    num = 2 * total + n * unit
    return (num - num % den) / den / 10000


def best(grid: DataFrame) -> DataFrame:
    """The grid row with the most clean windows, then coverage, then the least spread of starts."""
    return grid.orderBy(F.desc("clean_pct"), F.desc("coverage"), "start_stdev", "neg_q", "pos_q").limit(1)


def resolved(floor: Column, profile_start: Column, profile_stop: Column, drift: Column) -> tuple[Column, Column]:
    """Thresholds in order of preference: a profile's times drift, multiples of the noise floor, fixed ones."""
    pick = lambda own, times, fixed: F.when(own.isNotNull(), own * drift).when(floor.isNotNull(), floor * times).otherwise(F.lit(fixed))
    return pick(profile_start, 9.0, 1.74), pick(profile_stop, 1.5, 0.29)


def drift(floor: Column, profile_floor: Column, most: float = 1.4) -> Column:
    """floor / profile floor within [1 / most, most]; 1 if either is missing or the profile's is 0."""
    ratio = F.try_divide(floor, profile_floor)
    return F.coalesce(F.greatest(F.least(ratio, F.lit(most)), F.lit(1 / most)) * F.when(ratio.isNotNull(), 1.0), F.lit(1.0))
