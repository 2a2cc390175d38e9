"""Queries of stateful folds and streams over ``events``, and of log facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.operators import hooks
from clipflow.plans.gates import clips_sql, gate_sql
from clipflow.plans.registry import query
from clipflow.plans.segmentation import LEAST, SEGMENTS, START, STILL, STOP, clips, with_verdicts
from clipflow.plans.tables import FRAMES, HOUR, frames
from clipflow.operators.segment import replay_scores
from clipflow.sources.readers import read_hand_presence
from clipflow.sources.shared import shared_dir
from clipflow.sources.sinks import tee
from clipflow.streaming import folds as D
from clipflow.streaming import newest as N
from clipflow.streaming import sessions as E
from clipflow.streaming.machine import Gate

FIXED = Gate(start=START, stop=STOP, smooth=3, debounce=2, still=STILL, least=LEAST)
CAPPED = Gate(start=START, stop=STOP, smooth=3, debounce=2, still=STILL, least=LEAST, cap=24 * HOUR)
ADAPTIVE = Gate(start=START, stop=STOP, smooth=3, debounce=2, still=STILL, least=LEAST, adaptive=True, bootstrap=5, window=20, quiet_frames=2, stale=48 * HOUR)
HYBRID = Gate(start=START, stop=STOP, smooth=3, debounce=2, still=STILL, least=LEAST, vote_k=2, vote_n=5, factor=1.2, gated_vote=True, ring=20, ring_quiet=2, lead=1)
PROFILED = Gate(smooth=3, debounce=2, still=STILL, least=LEAST, profile=(START, STOP, 30.0), arming=5, window=20, quiet_frames=2, stale=48 * HOUR, cap=48 * HOUR)
COLUMNS = "session_id long, idx long, t long, score double, present boolean"


@query("segment_capped", clips_sql(CAPPED))
def segment_capped(spark, sf):
    return D.clips(frames(spark, sf), CAPPED)


@query("segment_adaptive", clips_sql(ADAPTIVE))
def segment_adaptive(spark, sf):
    return D.clips(frames(spark, sf), ADAPTIVE)


@query("segment_hybrid", clips_sql(HYBRID))
def segment_hybrid(spark, sf):
    """Presence is read from a file of detections, one row a frame, and counts only on frames that the pre-gate lets through."""
    f = frames(spark, sf)
    path = shared_dir(spark, "hands")
    f.select(F.col("event_id").alias("i"), F.when(F.col("present"), 1).otherwise(0).alias("n_hands")).write.json(path)
    seen = read_hand_presence(spark, path).select(F.col("idx").alias("event_id"), "present")
    return D.clips(f.drop("present").join(seen, "event_id", "left"), HYBRID)


@query("segment_profile", clips_sql(PROFILED))
def segment_profile(spark, sf):
    """Thresholds of a calibration profile times the drift of the noise floor, armed after a few frames."""
    return D.clips(frames(spark, sf), PROFILED)


#: Scales of all scores, each with a gate of fixed thresholds, of the noise floor, with presence and with a profile.
CONFIGS = {f"{name}:{scale}": (scale, gate) for scale in (0.8, 1.0, 1.25) for name, gate in (("fixed", CAPPED), ("adaptive", ADAPTIVE), ("hybrid", HYBRID), ("calibrated", PROFILED))}
REPLAYS = ", ".join(gate_sql(g, f"g{i}", scale) for i, (scale, g) in enumerate(CONFIGS.values()))
REPLAYED = " UNION ALL ".join(f"SELECT '{name}' AS config, * FROM g{i}_clips WHERE accepted" for i, name in enumerate(CONFIGS))
POSITIVE = "label IN ('SIGN', 'FINGERSPELL')"


@query("grid_scale", f"""WITH RECURSIVE {FRAMES}, {REPLAYS}, cl AS ({REPLAYED}), pos AS (SELECT session_id, idx FROM frames WHERE {POSITIVE}), names AS (SELECT unnest([{", ".join(f"'{n}'" for n in CONFIGS)}]) AS config),
hit AS (SELECT config, count(*) AS n FROM (SELECT DISTINCT config, p.session_id, p.idx FROM cl JOIN pos p ON p.session_id = cl.session_id AND p.idx BETWEEN start_idx AND end_idx) GROUP BY config),
bad AS (SELECT config, count(*) AS n FROM cl WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.session_id = cl.session_id AND p.idx BETWEEN start_idx AND end_idx) GROUP BY config)
SELECT config, (SELECT count(*) FROM cl WHERE cl.config = names.config) AS clips, round(100.0 * coalesce(hit.n, 0) / (SELECT count(*) FROM pos), 6) AS coverage_pct, coalesce(bad.n, 0) AS false_starts FROM names LEFT JOIN hit USING (config) LEFT JOIN bad USING (config)""")
def grid_scale(spark, sf):
    """Every scale with every configuration: the replayed clips' coverage and false starts, all gates in one pass over a session."""
    return replay_scores(D.bank(frames(spark, sf), CONFIGS).where("accepted"), frames(spark, sf), list(CONFIGS), F.col("label").isin("SIGN", "FINGERSPELL"))


@query("segment_fold", f"WITH {SEGMENTS} SELECT session_id, start_idx, end_idx, start_t, end_t FROM clips")
def segment_fold(spark, sf):
    """The step function with fixed thresholds: the same clips as the set form."""
    return D.clips(frames(spark, sf), FIXED).select("session_id", "start_idx", "end_idx", "start_t", "end_t")


@query("adaptive_floor", f"WITH RECURSIVE {FRAMES}, {gate_sql(ADAPTIVE)} SELECT session_id, floor, relax, CAST(len(samples) AS BIGINT) AS samples FROM g_last")
def adaptive_floor(spark, sf):
    return D.floors(frames(spark, sf), ADAPTIVE)


#: How far arrivals are out of order, and how long a session is idle before it is over: longer than any gap in the table.
DISORDER, IDLE = 24 * HOUR, 400 * 24 * HOUR


def landed(spark, sf, files=4, keep="true"):
    """Frames as files in the order of their times, moved by up to DISORDER; no order inside a file. One file after the other, as they would come."""
    path, once, f = shared_dir(spark, "frames"), shared_dir(spark, "moved"), frames(spark, sf).select(*E.FRAME).where(keep)
    each = f.withColumn("at", F.col("t") + F.pmod(F.xxhash64("session_id", "idx"), F.lit(DISORDER)))
    each.write.parquet(once)  # frames are numbered once, not for each file
    moved = spark.read.schema(each.schema).parquet(once)
    a, b = moved.agg(F.min("at"), F.max("at")).first()
    part = F.least(F.floor((F.col("at") - a) * files / (b - a + 1)), F.lit(files - 1))
    for k in range(files):
        moved.where(part == k).select(*E.FRAME).repartition(1, F.xxhash64("session_id", "idx")).write.mode("append").parquet(path)
    return path


@query("stream_segment", clips_sql(CAPPED))
def stream_segment(spark, sf):
    """Equal to the batch fold, the clips that are open at the end included."""
    return E.drained(spark, landed(spark, sf), COLUMNS, lambda d: E.clips(d, CAPPED, "48 hours", IDLE), shared_dir(spark, "clips")).rows


@query("in_order_emit", f"WITH {FRAMES} SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS n FROM frames WHERE idx % 13 <> 7")
def in_order_emit(spark, sf):
    """Every 13th index of a session never comes: the gap ends by the watermark, and the frames after it are released."""
    source = landed(spark, sf, keep="idx % 13 <> 7")
    return E.drained(spark, source, COLUMNS, lambda d: E.in_order(d, "48 hours", IDLE), shared_dir(spark, "ordered")).rows


@query("latest_only", f"WITH {FRAMES} SELECT session_id, arg_max(idx, idx) AS idx, arg_max(t, idx) AS t, arg_max(score, idx) AS score FROM frames GROUP BY session_id")
def latest_only(spark, sf):
    """One file a micro-batch, six of them, and the third batch once more."""
    out, source = shared_dir(spark, "latest"), landed(spark, sf, 6)
    N.run(spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source), f"{out}/data", f"{out}/checkpoint")
    N.upsert(frames(spark, sf).select(*E.FRAME).where("idx % 3 = 0"), 2, f"{out}/repeated")
    N.upsert(frames(spark, sf).select(*E.FRAME).where("idx % 3 = 0"), 2, f"{out}/repeated")
    both = N.read(spark, f"{out}/data", COLUMNS).unionByName(N.read(spark, f"{out}/repeated", COLUMNS))
    return N.newest(both).select("session_id", "idx", "t", "score")


#: One pattern for each kind of fact; a line may hold several messages.
FACTS = {
    "queued": r"Queued (clip_\d+) \(streamed\) \((\d+) frames, ([\d.]+)s signing",
    "ignored": r"Ignored — (.*?) \(([\d.]+)s signing, (\d+) frames\)",
    "translated": r"\[worker\] (clip_\d+) \(streamed\) translated in ([\d.]+)s",
    "said": r"Signer: (.*)$",
}


def log_lines(spark, sf):
    """A session log of the accepted and the ignored clips."""
    c = clips(spark, sf).withColumns({"frames": F.col("end_idx") - F.col("start_idx") + 1, "h": F.round((F.col("end_t") - F.col("start_t")) / float(HOUR), 1), "name": F.concat(F.lit("clip_"), F.col("start_idx").cast("string"))})
    queued = F.format_string("Queued %s (streamed) (%d frames, %.1fs signing; trimmed 0 lead-in + 0 still frames)[worker] %s (streamed) translated in %.1fs", "name", "frames", "h", "name", F.col("frames") / 2)
    ignored = F.format_string("Ignored — only %d%% of frames moving (%.1fs signing, %d frames).", F.floor(F.col("moving_fraction") * 100), "h", "frames")
    said = F.concat(F.lit("Signer: session "), F.col("session_id").cast("string"))
    return c.select(F.explode(F.when(F.col("accepted"), F.array(queued, said)).otherwise(F.array(ignored))).alias("value"))


def streamed_log(spark, sf, handle):
    source, out = shared_dir(spark, "log"), shared_dir(spark, "log-state")
    log_lines(spark, sf).write.text(source)
    q = spark.readStream.text(source).writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


@query("session_log_facts", f"""WITH {SEGMENTS} SELECT 'queued' AS fact, count(*) AS n, CAST(sum(end_idx - start_idx + 1) AS BIGINT) AS frames FROM clips WHERE accepted UNION ALL SELECT 'translated', count(*), NULL FROM clips WHERE accepted
UNION ALL SELECT 'said', count(*), NULL FROM clips WHERE accepted UNION ALL SELECT 'ignored', count(*), CAST(sum(end_idx - start_idx + 1) AS BIGINT) FROM clips WHERE NOT accepted""")
def session_log_facts(spark, sf):
    out = shared_dir(spark, "facts")
    frames_of = {"queued": 2, "ignored": 3}

    def facts(batch, _):
        each = [F.struct(F.lit(k).alias("fact"), F.rlike("value", F.lit(p)).alias("hit"), (F.regexp_extract("value", p, frames_of[k]).try_cast("long") if k in frames_of else F.lit(None).cast("long")).alias("frames")) for k, p in FACTS.items()]
        batch.select(F.inline(F.array(*each))).where("hit").select("fact", "frames").write.mode("append").parquet(out)

    streamed_log(spark, sf, facts)
    return spark.read.schema("fact string, frames long").parquet(out).groupBy("fact").agg(F.count("*").alias("n"), F.sum("frames").alias("frames"))


@query("log_tee", f"WITH {SEGMENTS} SELECT CAST(sum(CASE WHEN accepted THEN 2 ELSE 1 END) AS BIGINT) AS lines, count(*) FILTER (WHERE accepted) AS transcript FROM clips")
def log_tee(spark, sf):
    full, said = shared_dir(spark, "full"), shared_dir(spark, "said")
    streamed_log(spark, sf, lambda b, _: tee(b, full, said))
    return spark.read.text(full).agg(F.count("*").alias("lines")).join(spark.read.text(said).agg(F.count("*").alias("transcript")))


def start_sql(threshold: float | None) -> str:
    """Starts by phase and session, as a recursive table over each phase's frames."""
    hot = "true" if threshold is None else f"f.sm > {threshold}::DOUBLE"
    due = "true" if threshold is None else "above0 >= 2"
    return f"""SELECT session_id, phase, rn, starts FROM (WITH RECURSIVE st AS (SELECT session_id, phase, 0::BIGINT AS rn, []::BOOLEAN[] AS votes, 0 AS above, NULL::BIGINT AS lv, 0::BIGINT AS starts FROM ph WHERE rn = 1
UNION ALL SELECT session_id, phase, rn, CASE WHEN go THEN []::BOOLEAN[] ELSE votes0 END, CASE WHEN go THEN 0 ELSE above0 END, lv1, starts0 + CAST(go AS INTEGER) FROM (SELECT f.session_id, f.phase, f.rn, r.starts AS starts0, {hot} AS hot, CASE WHEN hot THEN r.above + 1 ELSE 0 END AS above0,
  hot AND f.vt IS DISTINCT FROM r.lv AS new, CASE WHEN new THEN f.vt ELSE r.lv END AS lv1, CASE WHEN new THEN list_append(r.votes, coalesce(f.verdict, false))[-5:] WHEN NOT hot THEN list_append(r.votes, false)[-5:] ELSE r.votes END AS votes0,
  f.t - f.t0 >= {12 * HOUR} AND coalesce(list_sum(list_transform(votes0, lambda x: CAST(x AS INTEGER))), 0) >= 2 AND {due} AS go FROM st r JOIN ph f ON f.session_id = r.session_id AND f.phase = r.phase AND f.rn = r.rn + 1)) SELECT * FROM st)"""


@query("start_counts", f"""WITH {FRAMES}, v AS (SELECT session_id, t AS vt, present AS verdict FROM frames WHERE k % 3 = 0),
fr AS (SELECT f.*, v.vt, v.verdict FROM frames f ASOF LEFT JOIN v ON v.session_id = f.session_id AND f.t >= v.vt),
ph AS (SELECT *, row_number() OVER (PARTITION BY session_id, phase ORDER BY idx) AS rn, min(t) OVER (PARTITION BY session_id) AS t0, round(avg(score) OVER (PARTITION BY session_id, phase ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS sm FROM fr),
c AS (SELECT 'pre_gated' AS mode, * FROM ({start_sql(STOP)}) UNION ALL SELECT 'presence', * FROM ({start_sql(None)}))
SELECT mode, phase, CAST(sum(starts) AS BIGINT) AS starts, CAST(sum(rn) AS BIGINT) AS frames FROM (SELECT mode, session_id, phase, arg_max(starts, rn) AS starts, max(rn) AS rn FROM c GROUP BY ALL) GROUP BY mode, phase""")
def start_counts(spark, sf):
    """Starts and frames per phase in two modes: verdicts on frames that a score gate lets through, or presence alone."""
    v = with_verdicts(frames(spark, sf))
    each = [D.trigger_starts(v, threshold, smooth=3, k=2, debounce=2, arming=12 * HOUR).select(F.lit(mode).alias("mode"), "phase", "starts", "frames") for mode, threshold in (("pre_gated", STOP), ("presence", None))]
    return each[0].union(each[1]).groupBy("mode", "phase").agg(F.sum("starts").alias("starts"), F.sum("frames").alias("frames"))


@query("stage_hook", f"WITH {FRAMES} SELECT session_id, idx, round(sum(score) OVER (PARTITION BY session_id ORDER BY idx), 4) AS total FROM frames")
def stage_hook(spark, sf):
    """A stage with state of its own per session: a running total."""

    def step(state, row):
        state["total"] = state.get("total", 0.0) + row["score"]
        return [{"idx": row["idx"], "total": state["total"]}]

    d = hooks.with_stage(frames(spark, sf), dict, step, "session_id long, idx long, total double")
    return d.withColumn("total", F.round("total", 4))
