"""Queries of distributions, threshold fits and quantiles over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.functions import quantiles as Q
from clipflow.operators import calibrate as K
from clipflow.operators import windows as O
from clipflow.plans.registry import query
from clipflow.plans.segmentation import SPANS, START, STOP, spanned
from clipflow.plans.tables import FRAMES, frames

NEG = "regexp_matches(upper({0}), '^(STAND STILL|SIT STILL|MOVE)')"
STL = "regexp_matches(upper({0}), '^(STAND STILL|SIT STILL)')"
N, S = NEG.format("label"), STL.format("label")


def labelled(spark, sf):
    """Frames whose phase is the calibration label."""
    return frames(spark, sf).drop("phase").withColumnRenamed("label", "phase")


@query("phase_class", f"WITH {FRAMES} SELECT label, {N} AS negative, {S} AS still, count(*) AS frames FROM frames GROUP BY label")
def phase_class(spark, sf):
    f = labelled(spark, sf)
    return f.groupBy(F.col("phase").alias("label"), K.is_negative().alias("negative"), K.is_still().alias("still")).agg(F.count("*").alias("frames"))


SETTLED = SPANS + f""", st AS (SELECT *, row_number() OVER (PARTITION BY session_id, span ORDER BY idx) AS rn0, count(*) OVER (PARTITION BY session_id, span) AS n0 FROM spans),
settled AS (SELECT * FROM st WHERE {N} OR (rn0 > 1 AND n0 > 1))"""


@query("settle_trim", f"WITH {SETTLED} SELECT session_id, idx, label, score FROM settled")
def settle_trim(spark, sf):
    return K.settled(spanned(spark, sf), 1).select("session_id", "idx", F.col("phase").alias("label"), "score")


METRICS = ["score", "k"]
LONG = FRAMES + ", long AS (SELECT label AS phase, 'score' AS metric, score AS v FROM frames UNION ALL SELECT label, 'k', CAST(k AS DOUBLE) FROM frames)"


def measured(spark, sf):
    return labelled(spark, sf).withColumn("k", F.col("k").cast("double"))


@query("phase_distribution", f"WITH {LONG} SELECT phase, metric, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max FROM long GROUP BY phase, metric")
def phase_distribution(spark, sf):
    return K.distribution(measured(spark, sf), METRICS)


NL = NEG.format("phase")


@query("separation_margin", f"""WITH {LONG}, q AS (SELECT metric, coalesce(quantile_cont(v, 0.99) FILTER (WHERE {NL}), 0) AS n, coalesce(quantile_cont(v, 0.1) FILTER (WHERE NOT {NL}), 0) AS p FROM long GROUP BY metric)
SELECT metric, round(n, 6) AS negative_p99, round(p, 6) AS positive_p10, round(p / nullif(n, 0), 6) AS margin, coalesce(p / nullif(n, 0) > 1, false) AS separable FROM q""")
def separation_margin(spark, sf):
    return K.separation(measured(spark, sf), METRICS)


@query("below_p99", f"WITH {FRAMES}, q AS (SELECT quantile_cont(score, 0.99) AS p99 FROM frames WHERE {N}) SELECT label AS phase, round(avg(CASE WHEN score <= p99 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct FROM frames, q GROUP BY label")
def below_p99(spark, sf):
    f = labelled(spark, sf)
    limit = Q.picked(f.where(K.is_negative()).withColumn("one", F.lit(1)), ["one"], "score", {"p99": (0.99, "linear")}).select("p99")  # one row
    return f.join(F.broadcast(limit)).groupBy("phase").agg(F.round(F.avg(F.when(F.col("score") <= F.col("p99"), 100.0).otherwise(0.0)), 6).alias("pct"))


FLOOR = "max(CASE WHEN rk = least(n - 1, CAST(floor({p} * n) AS BIGINT)) THEN v END)"


@query("hand_presence", f"""WITH {FRAMES}, v AS (SELECT label AS phase, score AS v, present, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM frames)
SELECT phase, round(avg(CASE WHEN present THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate, round(median(v), 6) AS p50, {FLOOR.format(p=0.9)} AS p90, {FLOOR.format(p=0.99)} AS p99 FROM v GROUP BY phase""")
def hand_presence(spark, sf):
    f = labelled(spark, sf)
    rate = f.groupBy("phase").agg(F.round(F.avg(F.when(F.col("present"), 1.0).otherwise(0.0)), 6).alias("rate"))
    p = Q.picked(f, ["phase"], "score", {"p50": (0.5, "linear"), "p90": (0.9, "floor"), "p99": (0.99, "floor")})
    return rate.join(p.withColumn("p50", F.round("p50", 6)), "phase")


@query("quantiles", f"""WITH {FRAMES}, v AS (SELECT label AS phase, score AS v, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM frames)
SELECT phase, round(quantile_cont(v, 0.37), 6) AS linear, max(CASE WHEN rk = CAST(round_even(0.37 * (n - 1), 0) AS BIGINT) THEN v END) AS nearest, {FLOOR.format(p=0.37)} AS floor, max(CASE WHEN rk = CAST(floor(0.975 * n) AS BIGINT) THEN v END) AS ci FROM v GROUP BY phase""")
def quantiles(spark, sf):
    f = labelled(spark, sf)
    p = Q.picked(f, ["phase"], "score", {"linear": (0.37, "linear"), "nearest": (0.37, "nearest"), "floor": (0.37, "floor"), "ci": (0.975, "ci")})
    return p.withColumn("linear", F.round("linear", 6))


@query("clip_percentiles", f"""WITH {FRAMES}, v AS (SELECT session_id, score AS v, row_number() OVER (PARTITION BY session_id ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY session_id) AS n FROM frames)
SELECT session_id, round(quantile_cont(v, 0.2), 6) AS p20, round(quantile_cont(v, 0.9), 6) AS p90, {FLOOR.format(p=0.1)} AS p10_floor, {FLOOR.format(p=0.5)} AS p50_floor, {FLOOR.format(p=0.95)} AS p95_floor FROM v GROUP BY session_id""")
def clip_percentiles(spark, sf):
    f = frames(spark, sf)
    linear = f.groupBy("session_id").agg(F.round(Q.linear("score", 0.2), 6).alias("p20"), F.round(Q.linear("score", 0.9), 6).alias("p90"))
    picks = {f"p{round(100 * p)}_floor": (p, "floor") for p in (0.1, 0.5, 0.95)}
    return linear.join(Q.picked_within(f, ["session_id"], "score", picks), "session_id")


@query("event_peaks", f"""WITH {FRAMES}, u AS (SELECT *, idx - lag(idx) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS gap FROM frames WHERE score > {START}),
e AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS event FROM u) SELECT session_id, CAST(event AS BIGINT) AS event, max(score) AS peak FROM e GROUP BY session_id, event""")
def event_peaks(spark, sf):
    f = frames(spark, sf).withColumn("rn", F.col("idx"))
    return K.event_peaks(f, F.col("score") > START, 2, ["session_id"])


@query("longest_quiet", f"""WITH {FRAMES}, q AS (SELECT session_id, idx, idx - row_number() OVER (PARTITION BY session_id ORDER BY idx) AS g FROM frames WHERE score <= {STOP}),
r AS (SELECT session_id, min(idx) AS run_start, count(*) AS frames FROM q GROUP BY session_id, g) SELECT session_id, arg_max(run_start, frames * 1000000 - run_start) AS run_start, max(frames) AS frames FROM r GROUP BY session_id""")
def longest_quiet(spark, sf):
    r = O.runs(frames(spark, sf), F.col("score") <= STOP)
    best = r.groupBy("session_id").agg(F.max(F.struct("frames", (-F.col("run_start")).alias("s"))).alias("b"))  # the first of equals
    return best.select("session_id", (-F.col("b.s")).alias("run_start"), F.col("b.frames").alias("frames"))


def fit_input(spark, sf, by):
    """Smoothed within spans, settled, numbered over the positive frames of each group."""
    f = O.smoothed(spanned(spark, sf), 3, ["session_id", "span"])
    d = K.settled(f, 1).drop("score").withColumnRenamed("smoothed", "score")
    order = ["t", "event_id"]
    return d.withColumn("__neg", K.is_negative()).withColumn("rn", F.row_number().over(O.over([*by, "__neg"], order))).drop("__neg")


def fit_sql(by: str) -> str:
    return SPANS + f""", ssm AS (SELECT * EXCLUDE (score), round(avg(score) OVER (PARTITION BY session_id, span ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS score FROM spans),
st AS (SELECT *, row_number() OVER (PARTITION BY session_id, span ORDER BY idx) AS rn0, count(*) OVER (PARTITION BY session_id, span) AS n0, {N} AS neg, {S} AS still FROM ssm),
d AS (SELECT *, row_number() OVER (PARTITION BY {by}, neg ORDER BY t, event_id) AS rn FROM st WHERE neg OR (rn0 > 1 AND n0 > 1)),
stats AS (SELECT {by}, max(score) FILTER (WHERE neg) AS neg_max, quantile_cont(score, 0.5) FILTER (WHERE neg) AS neg_p50, max(score) FILTER (WHERE still) AS still_max, max(score) FILTER (WHERE NOT neg) AS pos_max,
  quantile_cont(score, 0.5) FILTER (WHERE still) AS still_p50, quantile_cont(score, 0.5) FILTER (WHERE NOT neg) AS pos_p50 FROM d GROUP BY {by}),
up AS (SELECT d.*, rn - lag(rn) OVER (PARTITION BY {by} ORDER BY rn) - 1 AS gap FROM d JOIN stats USING ({by}) WHERE NOT neg AND score > neg_max),
ev AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY rn) AS event FROM up),
pk AS (SELECT {by}, count(*) AS events, quantile_cont(peak, 0.1) AS weakest FROM (SELECT {by}, event, max(score) AS peak FROM ev GROUP BY {by}, event) GROUP BY {by}),
j AS (SELECT * FROM stats LEFT JOIN pk USING ({by})),
fits AS (SELECT *, weakest / nullif(neg_max, 0) AS sep, CASE WHEN weakest IS NOT NULL AND weakest / nullif(neg_max, 0) >= 1.3 THEN 'ok' WHEN weakest IS NOT NULL THEN 'weak' WHEN pos_max IS NULL OR still_max IS NULL THEN 'no_data'
  WHEN pos_max <= 1.3::DOUBLE * still_max AND still_max >= 0.8::DOUBLE * neg_max THEN 'contaminated_still' WHEN pos_max <= 1.3::DOUBLE * still_max THEN 'retry' ELSE 'hand_gated' END AS status FROM j)
SELECT {by}, status, round(neg_max, 6) AS neg_max, round(neg_p50, 6) AS neg_p50, round(still_max, 6) AS still_max, round(pos_max, 6) AS pos_max, coalesce(events, 0) AS events, round(weakest, 6) AS weakest, round(sep, 6) AS separation,
  round(CASE WHEN weakest IS NOT NULL THEN sqrt(neg_max * weakest) WHEN status = 'hand_gated' THEN sqrt(still_max * pos_max) END, 6) AS start,
  round(CASE WHEN weakest IS NOT NULL THEN sqrt(neg_max * weakest) / 6 WHEN status = 'hand_gated' THEN sqrt(still_p50 * pos_p50) END, 6) AS stop FROM fits"""


@query("fit_thresholds", f"WITH {fit_sql('session_id')}")
def fit_thresholds(spark, sf):
    return K.fit(fit_input(spark, sf, ["session_id"]), 2, ["session_id"])


@query("fit_degraded", f"SELECT status, count(*) AS sessions, round(min(start), 6) AS least_start, round(max(stop), 6) AS most_stop FROM (WITH {fit_sql('session_id')}) WHERE status <> 'ok' GROUP BY status")
def fit_degraded(spark, sf):
    fits = K.fit(fit_input(spark, sf, ["session_id"]), 2, ["session_id"]).where("status <> 'ok'")
    return fits.groupBy("status").agg(F.count("*").alias("sessions"), F.round(F.min("start"), 6).alias("least_start"), F.round(F.max("stop"), 6).alias("most_stop"))


@query("fit_short", f"""WITH {FRAMES}, q AS (SELECT session_id, quantile_cont(score, 0.9) FILTER (WHERE {N}) AS n, quantile_cont(score, 0.75) FILTER (WHERE NOT {N}) AS p FROM frames GROUP BY session_id)
SELECT session_id, round(n, 6) AS neg_hi, round(p, 6) AS pos_hi, round(CASE WHEN p <= n THEN n * 1.05::DOUBLE ELSE sqrt(n * p) END, 6) AS start FROM q""")
def fit_short(spark, sf):
    return K.short_fit(labelled(spark, sf), ["session_id"], 0.9, 0.75)


GRID = [(a, b) for a in (0.8, 0.9, 0.95) for b in (0.6, 0.75, 0.9)]
SIGNING = ("SIGN", "FINGERSPELL")


#: A quotient in whole numbers, half up, as ten-thousandths: no order of addition can move it.
EXACT = "1.0::DOUBLE * ((2 * {s}::HUGEINT + {n}) // (2 * {n})) / 10000"
GRID_SQL = f"""{FRAMES}, g(neg_q, pos_q) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in GRID)}),
cls AS (SELECT *, {N} AS neg, row_number() OVER (PARTITION BY session_id, {N} ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY session_id, {N}) AS n FROM frames),
win AS (SELECT c.session_id, c.neg, w, c.score FROM (SELECT *, CASE WHEN neg THEN 8 ELSE 10 END AS step, CASE WHEN neg THEN 16 ELSE 20 END AS size FROM cls) c, unnest(range(0, c.n // c.step + 1)) AS r(w) WHERE (w = 0 OR w * step < n - size) AND c.rn >= w * step AND c.rn < w * step + size),
nw AS (SELECT session_id, w, unnest([0.8::DOUBLE, 0.9, 0.95]) AS neg_q, unnest(q) AS n FROM (SELECT session_id, w, quantile_cont(score, [0.8, 0.9, 0.95]) AS q FROM win WHERE neg GROUP BY ALL)),
pw AS (SELECT session_id, w, unnest([0.6::DOUBLE, 0.75, 0.9]) AS pos_q, unnest(q) AS p FROM (SELECT session_id, w, quantile_cont(score, [0.6, 0.75, 0.9]) AS q FROM win WHERE NOT neg GROUP BY ALL)),
st AS (SELECT nw.session_id, nw.w AS nw, pw.w AS pw, neg_q, pos_q, round(CASE WHEN p <= n THEN n * 1.05::DOUBLE ELSE sqrt(n * p) END, 6) AS start FROM nw JOIN pw ON pw.session_id = nw.session_id JOIN g USING (neg_q, pos_q)),
ev AS (SELECT st.session_id, nw, pw, neg_q, pos_q, start, CAST(round(100000000.0::DOUBLE * count(*) FILTER (WHERE label IN ('SIGN', 'FINGERSPELL') AND score > start) / nullif(count(*) FILTER (WHERE label IN ('SIGN', 'FINGERSPELL')), 0), 0) AS BIGINT) AS coverage, count(*) FILTER (WHERE {N} AND score > start) AS false_frames FROM st JOIN frames f ON f.session_id = st.session_id GROUP BY ALL),
grid AS (SELECT neg_q, pos_q, count(*) AS windows, round(median(start), 6) AS start_median, round(stddev_pop(start), 4) AS start_stdev, {EXACT.format(s="sum(coverage)", n="count(coverage) * 100")} AS coverage, {EXACT.format(s="sum(false_frames) * 10000", n="count(false_frames)")} AS false_frames, {EXACT.format(s="count(*) FILTER (WHERE false_frames = 0) * 1000000", n="count(*)")} AS clean_pct FROM ev GROUP BY neg_q, pos_q)"""


@query("grid_eval", f"WITH {GRID_SQL} SELECT * FROM grid")
def grid_eval(spark, sf):
    """All pairs of a still and a signing window of a session, a quantile pair per grid row, and how each start does on the session's frames."""
    return K.grid(labelled(spark, sf), GRID, SIGNING)


@query("best_grid_row", f"WITH {GRID_SQL} SELECT * FROM grid ORDER BY clean_pct DESC, coverage DESC, start_stdev, neg_q, pos_q LIMIT 1")
def best_grid_row(spark, sf):
    """Never a false start first, then the most signing, then the steadiest start."""
    return K.best(K.grid(labelled(spark, sf), GRID, SIGNING))


FLOORS = FRAMES + """, fl AS (SELECT session_id, quantile_cont(score, 0.1) AS floor, quantile_cont(score, 0.2) AS own, CASE WHEN session_id % 3 = 0 THEN max(score) END AS p_start, CASE WHEN session_id % 3 = 0 THEN max(score) / 6 END AS p_stop FROM frames GROUP BY session_id),
dr AS (SELECT *, CASE WHEN session_id % 4 <> 1 THEN floor END AS f, CASE WHEN session_id % 3 = 0 THEN own END AS pf FROM fl)"""


def floors(spark, sf):
    s = F.col("session_id")
    base = frames(spark, sf).groupBy("session_id").agg(Q.linear("score", 0.1).alias("floor"), Q.linear("score", 0.2).alias("own"), F.max("score").alias("m"))
    return base.select("session_id", F.when(s % 4 != 1, F.col("floor")).alias("f"), F.when(s % 3 == 0, F.col("own")).alias("pf"), F.when(s % 3 == 0, F.col("m")).alias("p_start"), F.when(s % 3 == 0, F.col("m") / 6).alias("p_stop"))


@query("drift_clamp", f"WITH {FLOORS} SELECT session_id, round(CASE WHEN f IS NULL OR pf IS NULL OR pf = 0 THEN 1.0::DOUBLE ELSE greatest(least(f / pf, 1.4::DOUBLE), 1 / 1.4::DOUBLE) END, 6) AS drift, coalesce(f / nullif(pf, 0) > 1.4 OR f / nullif(pf, 0) < 1 / 1.4::DOUBLE, false) AS clamped FROM dr")
def drift_clamp(spark, sf):
    ratio = F.try_divide("f", "pf")
    return floors(spark, sf).select("session_id", F.round(K.drift(F.col("f"), F.col("pf")), 6).alias("drift"), F.coalesce((ratio > 1.4) | (ratio < 1 / 1.4), F.lit(False)).alias("clamped"))


@query("threshold_resolve", f"WITH {FLOORS}, x AS (SELECT *, CASE WHEN f IS NULL OR pf IS NULL OR pf = 0 THEN 1.0::DOUBLE ELSE greatest(least(f / pf, 1.4::DOUBLE), 1 / 1.4::DOUBLE) END AS drift FROM dr) SELECT session_id, round(CASE WHEN p_start IS NOT NULL THEN p_start * drift WHEN f IS NOT NULL THEN f * 9 ELSE 1.74 END, 6) AS start, round(CASE WHEN p_stop IS NOT NULL THEN p_stop * drift WHEN f IS NOT NULL THEN f * 1.5::DOUBLE ELSE 0.29 END, 6) AS stop FROM x")
def threshold_resolve(spark, sf):
    start, stop = K.resolved(F.col("f"), F.col("p_start"), F.col("p_stop"), K.drift(F.col("f"), F.col("pf")))
    return floors(spark, sf).select("session_id", F.round(start, 6).alias("start"), F.round(stop, 6).alias("stop"))
