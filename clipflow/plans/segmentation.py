"""Queries of frames, windows, segmentation and trims over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.operators import segment as S
from clipflow.operators import windows as O
from clipflow.plans.registry import query
from clipflow.plans.tables import FRAMES, HOUR, SMOOTH, frames

START, STOP, STILL, LEAST = 60.0, 35.0, 6 * HOUR, HOUR


def smoothed(spark, sf):
    return O.smoothed(frames(spark, sf), 3)


def clips(spark, sf):
    f = smoothed(spark, sf)
    return S.accepted(S.moving_fraction(S.segments(f, START, STOP, 2, STILL), f, STOP), LEAST)


SEGMENTS = SMOOTH + f""", deb AS (SELECT *, lag(t) OVER w AS before,
  coalesce(min(smoothed) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) > {START} AND count(*) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2, false) AS starts
  FROM sm WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
mot AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY idx) AS last_motion FROM deb WHERE smoothed > {STOP}),
isl AS (SELECT *, sum(CASE WHEN last_motion IS NULL OR before - last_motion >= {STILL} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS island FROM mot),
raw_clips AS (SELECT session_id, min(idx) FILTER (WHERE starts) AS start_idx, max(idx) AS end_idx, min(t) FILTER (WHERE starts) AS start_t, max(t) AS end_t FROM isl GROUP BY session_id, island HAVING count(*) FILTER (WHERE starts) > 0),
frac AS (SELECT c.*, round(avg(CASE WHEN f.score > {STOP} THEN 1.0::DOUBLE ELSE 0 END), 6) AS moving_fraction FROM raw_clips c JOIN frames f ON f.session_id = c.session_id AND f.idx BETWEEN c.start_idx AND c.end_idx GROUP BY ALL),
clips AS (SELECT *, end_t - start_t >= {LEAST} AND moving_fraction >= 0.5 AS accepted FROM frac)"""


@query("segment_sql", f"WITH {SEGMENTS} SELECT *, CASE WHEN accepted THEN CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_idx) AS BIGINT) END AS clip_no FROM clips")
def segment_sql(spark, sf):
    return clips(spark, sf)


@query("clip_accept", f"WITH {SEGMENTS} SELECT session_id, start_idx, end_idx - start_idx + 1 AS frames, moving_fraction FROM clips WHERE accepted")
def clip_accept(spark, sf):
    return clips(spark, sf).where("accepted").select("session_id", "start_idx", (F.col("end_idx") - F.col("start_idx") + 1).alias("frames"), "moving_fraction")


@query("moving_fraction", f"WITH {SEGMENTS} SELECT session_id, start_idx, moving_fraction FROM clips")
def moving_fraction(spark, sf):
    return clips(spark, sf).select("session_id", "start_idx", "moving_fraction")


@query("empty_flag", f"""WITH {SEGMENTS} SELECT session_id, start_idx,
  CASE WHEN (end_t - start_t) / 3600000000.0 < 1.0 THEN printf('no signing detected, trim span %.2fs', (end_t - start_t) / 3600000000.0) WHEN moving_fraction < 0.5 THEN printf('only %d%% of frames moving', CAST(floor(moving_fraction * 100) AS INTEGER)) END AS note FROM clips""")
def empty_flag(spark, sf):
    span = (F.col("end_t") - F.col("start_t")) / float(HOUR)
    return clips(spark, sf).select("session_id", "start_idx", S.empty_note(span, F.col("moving_fraction")).alias("note"))


@query("flag_join", f"""WITH {SEGMENTS}, notes AS (SELECT session_id, start_idx, 'only ' || CAST(CAST(floor(moving_fraction * 100) AS INTEGER) AS VARCHAR) || '% of frames moving' AS note FROM clips WHERE moving_fraction < 0.8)
SELECT c.session_id, c.start_idx, CASE WHEN note IS NULL THEN 'clip ' || c.start_idx ELSE '[' || note || ' — likely invented] clip ' || c.start_idx END AS text FROM clips c LEFT JOIN notes n ON n.session_id = c.session_id AND n.start_idx = c.start_idx""")
def flag_join(spark, sf):
    c = clips(spark, sf)
    notes = c.where("moving_fraction < 0.8").select("session_id", "start_idx", F.concat(F.lit("only "), F.floor(F.col("moving_fraction") * 100).cast("string"), F.lit("% of frames moving")).alias("note"))
    text = F.concat(F.lit("clip "), F.col("start_idx").cast("string"))
    flagged = F.coalesce(F.concat(F.lit("["), F.col("note"), F.lit(" — likely invented] "), text), text)
    return c.join(notes, ["session_id", "start_idx"], "left").select("session_id", "start_idx", flagged.alias("text"))


@query("smooth", f"WITH {SMOOTH} SELECT session_id, idx, smoothed FROM sm")
def smooth(spark, sf):
    return smoothed(spark, sf).select("session_id", "idx", "smoothed")


@query("stride_sample", f"WITH {FRAMES} SELECT session_id, idx, event_id FROM frames WHERE idx % 2 = 0")
def stride_sample(spark, sf):
    return O.strided(frames(spark, sf), 2).select("session_id", "idx", "event_id")


SPANS = FRAMES + """, chg AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS changed FROM frames),
spans AS (SELECT *, sum(changed) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS span FROM chg)"""


def spanned(spark, sf):
    f = frames(spark, sf).drop("phase").withColumnRenamed("label", "phase")
    return O.phase_spans(f)


@query("phase_spans", f"WITH {SPANS} SELECT session_id, CAST(span AS BIGINT) AS span, min(label) AS phase, min(idx) AS start_idx, max(idx) AS end_idx FROM spans GROUP BY session_id, span")
def phase_spans(spark, sf):
    return spanned(spark, sf).groupBy("session_id", "span").agg(F.min("phase").alias("phase"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))


@query("debounce", f"""WITH {SMOOTH} SELECT session_id, idx FROM (SELECT *, min(smoothed) OVER w > {START} AND count(*) OVER w = 2 AS deb FROM sm WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WHERE deb""")
def debounce(spark, sf):
    return smoothed(spark, sf).withColumn("d", O.debounced("smoothed", START, 2)).where("d").select("session_id", "idx")


@query("k_of_n", f"""WITH {FRAMES} SELECT session_id, idx, sum(CASE WHEN present THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS voted FROM frames""")
def k_of_n(spark, sf):
    return frames(spark, sf).select("session_id", "idx", O.k_of_n(F.col("present"), 3, 5).alias("voted"))


@query("rolling_fps", f"""WITH {FRAMES}, d AS (SELECT session_id, idx, (t - lag(t) OVER (PARTITION BY session_id ORDER BY idx)) / 1e6 AS dt FROM frames)
SELECT session_id, idx, round(1e6 / avg(dt) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 3) AS per_second FROM d""")
def rolling_fps(spark, sf):
    d = frames(spark, sf).withColumn("dt", (F.col("t") - F.lag("t").over(O.over())) / 1e6)
    return d.select("session_id", "idx", F.round(O.rolling_rate("dt") * 1e6, 3).alias("per_second"))


@query("motion_onset", f"""WITH {SEGMENTS}, q AS (SELECT session_id, idx AS e FROM (SELECT *, max(score) OVER w <= {STOP} AND count(score) OVER w = 2 AS quiet FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WHERE quiet),
m AS (SELECT c.session_id, c.start_idx AS trigger_idx, greatest(c.start_idx - 19, 0) AS low, max(e) AS e FROM clips c LEFT JOIN q ON q.session_id = c.session_id AND e <= c.start_idx AND e - 1 >= greatest(c.start_idx - 19, 0) GROUP BY ALL)
SELECT session_id, trigger_idx, greatest((CASE WHEN e IS NULL THEN low ELSE least(e + 1, trigger_idx) END) - 1, low) AS onset_idx FROM m""")
def motion_onset(spark, sf):
    triggers = clips(spark, sf).select("session_id", F.col("start_idx").alias("trigger_idx"))
    return S.motion_onset(triggers, frames(spark, sf), STOP, ring=20, quiet=2, lead=1)


@query("head_trim", f"""WITH {FRAMES}, g AS (SELECT *, score > {STOP} AS motion, coalesce(sum(CASE WHEN score > {STOP} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, min(t) OVER (PARTITION BY session_id) AS t0 FROM frames),
s AS (SELECT *, min(CASE WHEN NOT motion THEN t END) OVER (PARTITION BY session_id, run) AS since FROM g),
o AS (SELECT session_id, min(idx) AS onset_idx, min(t) AS ot FROM s WHERE motion AND t - since >= {4 * HOUR} AND t - t0 <= {96 * HOUR} GROUP BY session_id)
SELECT f.session_id, max(onset_idx) AS onset_idx, coalesce(min(CASE WHEN t >= ot - {2 * HOUR} THEN idx END), 0) AS keep_idx FROM frames f LEFT JOIN o ON o.session_id = f.session_id GROUP BY f.session_id""")
def head_trim(spark, sf):
    return S.head_trim(frames(spark, sf), STOP, 96 * HOUR, 4 * HOUR, 2 * HOUR)


@query("tail_trim", f"""WITH {FRAMES}, e AS (SELECT session_id, max(CASE WHEN score > {STOP} THEN t END) AS motion, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY session_id),
a AS (SELECT session_id, coalesce(motion + {HOUR}, t1) AS auto, t0, t1 FROM e), m AS (SELECT *, CASE WHEN greatest(auto, t1 - {24 * HOUR}) - t0 < {HOUR} THEN t1 ELSE greatest(auto, t1 - {24 * HOUR}) END AS manual FROM a)
SELECT f.session_id, count(*) FILTER (WHERE t <= auto) AS auto_kept, count(*) FILTER (WHERE t <= manual) AS manual_kept, count(*) AS frames FROM frames f JOIN m ON m.session_id = f.session_id GROUP BY f.session_id""")
def tail_trim(spark, sf):
    return S.tail_trim(frames(spark, sf), STOP, HOUR, 24 * HOUR, HOUR)


@query("percentile_trim", f"""WITH {FRAMES}, p AS (SELECT session_id, count(*) AS n, round(greatest(0.5, quantile_cont(score, 0.2) + 0.25 * (quantile_cont(score, 0.9) - quantile_cont(score, 0.2))), 6) AS threshold FROM frames GROUP BY session_id),
a AS (SELECT f.session_id, n, threshold, min(CASE WHEN score > threshold THEN idx END) AS a, max(CASE WHEN score > threshold THEN idx END) AS b FROM frames f JOIN p ON p.session_id = f.session_id GROUP BY ALL),
k AS (SELECT *, greatest(a - 2, 0) AS lo, least(b + 2, n - 1) AS hi FROM a)
SELECT session_id, threshold, CASE WHEN a IS NULL OR hi - lo + 1 < 0.4 * n THEN 0 ELSE lo END AS first_idx, CASE WHEN a IS NULL OR hi - lo + 1 < 0.4 * n THEN n - 1 ELSE hi END AS last_idx FROM k""")
def percentile_trim(spark, sf):
    return S.percentile_trim(frames(spark, sf), 2)


@query("segment_count", f"""WITH {FRAMES}, e AS (SELECT *, max(idx) OVER (PARTITION BY session_id) AS last FROM frames),
m AS (SELECT *, idx - lag(idx) OVER (PARTITION BY session_id ORDER BY idx) AS gap FROM e WHERE score >= {STOP}),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS island FROM m),
c AS (SELECT session_id, min(CASE WHEN score > {START} THEN idx END) AS start_idx, max(idx) + 2 AS end_idx, max(last) AS last FROM i GROUP BY session_id, island)
SELECT session_id, start_idx, end_idx, end_idx - start_idx + 1 AS frames FROM c WHERE start_idx IS NOT NULL AND end_idx <= last AND end_idx - start_idx + 1 >= 4""")
def segment_count(spark, sf):
    return S.segments_by_count(frames(spark, sf), START, STOP, 2, 4)


@query("segment_time", f"""WITH {FRAMES}, d AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY idx) AS before FROM frames),
m AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY idx) AS last_motion FROM d WHERE score > {STOP}),
i AS (SELECT *, sum(CASE WHEN last_motion IS NULL OR before - last_motion >= {STILL} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS island FROM m),
c AS (SELECT session_id, min(idx) FILTER (WHERE score > {START}) AS start_idx, min(t) FILTER (WHERE score > {START}) AS start_t, max(t) AS last_t FROM i GROUP BY session_id, island)
SELECT c.session_id, start_idx, min(f.idx) AS end_idx, min(f.t) - start_t AS elapsed FROM c JOIN frames f ON f.session_id = c.session_id AND f.t - last_t >= {STILL} WHERE start_idx IS NOT NULL GROUP BY c.session_id, start_idx, start_t HAVING min(f.t) - start_t >= {LEAST}""")
def segment_time(spark, sf):
    return S.segments_by_time(frames(spark, sf), START, STOP, STILL, LEAST)


SCORED = SEGMENTS + ", " + SPANS.removeprefix(FRAMES).lstrip(", ") + """, pos AS (SELECT * FROM spans WHERE label IN ('SIGN', 'FINGERSPELL')), ok AS (SELECT * FROM clips WHERE accepted)"""


@query("segment_score", f"""WITH {SCORED},
met AS (SELECT p.session_id, p.span, p.a, count(*) AS n, min(start_idx) AS s FROM (SELECT session_id, span, min(idx) AS a, max(idx) AS b FROM pos GROUP BY session_id, span) p JOIN ok c ON c.session_id = p.session_id AND start_idx <= b AND end_idx >= a GROUP BY ALL)
SELECT (SELECT count(*) FROM ok) AS n_clips,
 round(100.0 * (SELECT count(*) FROM pos p WHERE EXISTS (SELECT 1 FROM ok c WHERE c.session_id = p.session_id AND p.idx BETWEEN start_idx AND end_idx)) / (SELECT count(*) FROM pos), 6) AS coverage_pct,
 (SELECT count(*) FROM ok c WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE c.session_id = p.session_id AND p.idx BETWEEN start_idx AND end_idx)) AS false_starts,
 CAST(coalesce((SELECT sum(n - 1) FROM met), 0) AS BIGINT) AS fragments, coalesce((SELECT max(greatest(s - a, 0)) FROM met), 0) AS lead_lost""")
def segment_score(spark, sf):
    return S.segment_score(clips(spark, sf).where("accepted"), spanned(spark, sf), F.col("phase").isin("SIGN", "FINGERSPELL"))


@query("hand_join", f"""WITH {FRAMES}, hands AS (SELECT session_id, idx, k % 2 = 0 AS present FROM frames WHERE k % 3 = 0)
SELECT f.session_id, f.idx, coalesce(h.present, false) AS present FROM frames f LEFT JOIN hands h ON h.session_id = f.session_id AND h.idx = f.idx""")
def hand_join(spark, sf):
    f = frames(spark, sf)
    hands = f.where("k % 3 = 0").select("session_id", "idx", "present")
    return f.select("session_id", "idx").join(hands, ["session_id", "idx"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


@query("verdict_asof", f"""WITH {FRAMES}, v AS (SELECT session_id, t AS vt, present AS verdict FROM frames WHERE k % 3 = 0)
SELECT f.session_id, f.idx, v.verdict, v.vt IS NOT NULL AND v.vt IS DISTINCT FROM lag(v.vt) OVER (PARTITION BY f.session_id ORDER BY f.idx) AS fresh FROM frames f ASOF LEFT JOIN v ON v.session_id = f.session_id AND f.t >= v.vt""")
def verdict_asof(spark, sf):
    return with_verdicts(frames(spark, sf)).select("session_id", "idx", "verdict", "fresh")


def with_verdicts(f):
    """The latest detector verdict at or before each frame; fresh the first time that it is seen."""
    is_verdict = F.col("k") % 3 == 0
    seen = f.withColumns({"vt": F.when(is_verdict, F.col("t")), "verdict": F.when(is_verdict, F.col("present"))})
    seen = seen.withColumns({"vt": O.filled("vt"), "verdict": O.filled("verdict")})
    return seen.withColumn("fresh", F.col("vt").isNotNull() & ~F.col("vt").eqNullSafe(F.lag("vt").over(O.over())))


@query("verdict_counts", f"""WITH {FRAMES}, v AS (SELECT session_id, t AS vt, present AS verdict FROM frames WHERE k % 3 = 0),
a AS (SELECT f.phase, v.verdict, v.vt IS NOT NULL AND v.vt IS DISTINCT FROM lag(v.vt) OVER (PARTITION BY f.session_id ORDER BY f.idx) AS fresh FROM frames f ASOF LEFT JOIN v ON v.session_id = f.session_id AND f.t >= v.vt)
SELECT phase, count(*) AS frames, count(*) FILTER (WHERE fresh) AS verdicts, count(*) FILTER (WHERE fresh AND verdict) AS with_hands FROM a GROUP BY phase""")
def verdict_counts(spark, sf):
    return with_verdicts(frames(spark, sf)).groupBy("phase").agg(F.count("*").alias("frames"), F.count_if("fresh").alias("verdicts"), F.count_if(F.col("fresh") & F.col("verdict")).alias("with_hands"))


@query("label_frames", f"""WITH {FRAMES}, lab AS (SELECT session_id, idx, label FROM frames WHERE k % 3 <> 1) SELECT f.session_id, f.idx, l.label, f.score FROM frames f JOIN lab l ON l.session_id = f.session_id AND l.idx = f.idx WHERE f.idx % 2 = 0""")
def label_frames(spark, sf):
    f = frames(spark, sf)
    labels = f.where("k % 3 <> 1").select("session_id", "idx", "label")  # a label table with gaps anywhere
    return O.strided(f.select("session_id", "idx", "score").join(labels, ["session_id", "idx"]), 2)


@query("max_concurrency", f"""WITH {SEGMENTS}, ev AS (SELECT start_t AS t, 1 AS d, end_idx - start_idx + 1 AS n FROM clips WHERE accepted UNION ALL SELECT end_t, -1, -(end_idx - start_idx + 1) FROM clips WHERE accepted),
b AS (SELECT t, sum(d) AS d, sum(n) AS n FROM ev GROUP BY t), r AS (SELECT sum(d) OVER (ORDER BY t) AS d, sum(n) OVER (ORDER BY t) AS n FROM b) SELECT CAST(max(d) AS BIGINT) AS most_clips, CAST(max(n) AS BIGINT) AS most_frames FROM r""")
def max_concurrency(spark, sf):
    from clipflow.operators.sweep import most_at_once

    c = clips(spark, sf).where("accepted").withColumn("frames", F.col("end_idx") - F.col("start_idx") + 1)
    return most_at_once(c, "start_t", "end_t", {"most_clips": F.lit(1), "most_frames": F.col("frames")})
