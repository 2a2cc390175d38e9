"""The gate in DuckDB SQL: a recursive table of one row a session and frame, written from a ``Gate``'s fields.

It holds the state after each frame and the clip, if any, that the frame ends. It shares no code with the step function.
"""

from __future__ import annotations

from clipflow.plans.tables import FRAMES
from clipflow.streaming.machine import Gate


def gate_sql(gate: Gate, name: str = "g", scale: float = 1.0, frames: str = "frames") -> str:
    """CTEs ending in ``{name}_clips`` (the columns of a clip) and ``{name}_last`` (each session's state after its last frame). Needs ``frames``."""
    learns = gate.adaptive or gate.profile is not None
    q, ring = gate.ring_quiet, gate.ring
    if gate.profile is not None:
        start, stop, floor = gate.profile
        drift = f"CASE WHEN {{0}} IS NULL THEN 1.0::DOUBLE ELSE least(1.4::DOUBLE, greatest(1 / 1.4::DOUBLE, {{0}} / {floor}::DOUBLE)) END" if floor else "1.0::DOUBLE"
        start_of, stop_of = (lambda f: f"({start}::DOUBLE * {drift.format(f)})"), (lambda f: f"({stop}::DOUBLE * {drift.format(f)})")
        armed = f"f.idx + 1 >= {gate.arming}"
    elif gate.adaptive:
        start_of, stop_of = (lambda f: f"coalesce({f} * 9.0::DOUBLE, {gate.start}::DOUBLE)"), (lambda f: f"coalesce({f} * 1.5::DOUBLE, {gate.stop}::DOUBLE)")
        armed = "fl IS NOT NULL"
    else:
        start_of, stop_of, armed = (lambda f: f"{gate.start}::DOUBLE"), (lambda f: f"{gate.stop}::DOUBLE"), "true"
    boot = "false" if gate.profile is not None else "r.boot"
    quiet_end = f"""max(CASE WHEN qrun THEN idx END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN {max(ring - q, 0)} PRECEDING AND CURRENT ROW)"""
    begin = f"greatest(idx - {ring - 1}, 0) + greatest(0, CASE WHEN jq IS NULL THEN 0 ELSE least(jq - greatest(idx - {ring - 1}, 0) + 1, idx - greatest(idx - {ring - 1}, 0)) - {gate.lead} END)" if ring else "idx"
    learn = "r.floor AS fl, r.relax AS relax1, r.quiet AS quiet1, r.quiet_t AS quiet_t1, r.samples AS samples1, r.boot AS boot1"
    if learns:
        learn = f"""NOT r.open AND {boot} AS booting, NOT r.open AND NOT {boot} AND f.sm > {stop_of("r.floor")} * 1.5::DOUBLE * r.relax AS loud, NOT r.open AND NOT {boot} AND NOT loud AS calm,
  CASE WHEN calm THEN r.quiet + 1 WHEN loud THEN 0 ELSE r.quiet END AS quiet1, calm AND quiet1 >= {gate.quiet_frames} AS takes, loud AND r.quiet_t IS NOT NULL AND f.t - r.quiet_t > {gate.stale} AS stale,
  CASE WHEN booting THEN list_append(r.samples, f.sm) WHEN takes THEN list_append(r.samples, f.sm)[-{gate.window}:] ELSE r.samples END AS samples1,
  CASE WHEN takes THEN 1.0::DOUBLE WHEN stale THEN r.relax * 1.5::DOUBLE ELSE r.relax END AS relax1, CASE WHEN booting OR takes OR stale THEN f.t ELSE r.quiet_t END AS quiet_t1,
  booting AND len(samples1) >= {gate.bootstrap} AS booted, r.boot AND NOT booted AS boot1,
  CASE WHEN booted THEN greatest(0.02::DOUBLE, list_sort(samples1)[CAST(round_even(0.1::DOUBLE * (len(samples1) - 1), 0) AS INTEGER) + 1]) WHEN takes THEN greatest(0.02::DOUBLE, list_median(samples1)) ELSE r.floor END AS fl"""
    vote = f"""list_append(r.votes, coalesce(f.present, false){' AND hot' if gate.gated_vote else ''})[-{gate.vote_n}:]""" if gate.vote_k else "r.votes"
    voted = f"coalesce(list_sum(list_transform(votes0, lambda x: CAST(x AS INTEGER))), 0) >= {gate.vote_k}" if gate.vote_k else "true"
    forced = f"goes AND f.t - r.s_t >= {gate.cap}" if gate.cap is not None else "false"
    return f"""{name}_sm AS (SELECT session_id, idx, t, score * {scale}::DOUBLE AS score, present FROM {frames}),
{name}_w AS (SELECT *, round(avg(score) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN {gate.smooth - 1} PRECEDING AND CURRENT ROW), 6) AS sm,
  max(score) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN {q - 1} PRECEDING AND CURRENT ROW) <= {stop_of("NULL::DOUBLE") if not learns else gate.stop} AND idx >= {q - 1} AS qrun FROM {name}_sm),
{name}_j AS (SELECT *, {quiet_end} AS jq FROM {name}_w),
{name}_b AS (SELECT *, {begin} AS b_idx FROM {name}_j),
{name}_f AS (SELECT a.*, b.t AS b_t FROM {name}_b a JOIN {frames} b ON b.session_id = a.session_id AND b.idx = a.b_idx),
{name} AS (SELECT session_id, -1::BIGINT AS idx, NULL::DOUBLE AS floor, 1.0::DOUBLE AS relax, 0 AS quiet, NULL::BIGINT AS quiet_t, []::DOUBLE[] AS samples, true AS boot, 0 AS hits, []::BOOLEAN[] AS votes,
  false AS open, NULL::BIGINT AS s_idx, NULL::BIGINT AS s_t, NULL::BIGINT AS l_idx, NULL::BIGINT AS l_t, 0 AS moving, 0 AS scored, NULL::BIGINT AS e_start, NULL::BIGINT AS e_end, NULL::BIGINT AS e_start_t, NULL::BIGINT AS e_end_t, false AS e_forced, NULL::DOUBLE AS e_share FROM {name}_f WHERE idx = 0
UNION ALL SELECT session_id, idx, fl, relax1, quiet1, quiet_t1, samples1, boot1, hits1, votes1, open1, s1, st1, l1, lt1, moving1, scored1,
  CASE WHEN ends OR cut THEN o_s END, CASE WHEN cut THEN idx WHEN ends THEN o_l END, CASE WHEN ends OR cut THEN o_st END, CASE WHEN cut THEN t WHEN ends THEN o_lt END, cut, CASE WHEN ends THEN o_moving / o_scored::DOUBLE WHEN cut THEN (o_moving + up) / (o_scored + 1)::DOUBLE END
FROM (SELECT f.session_id, f.idx, f.t, r.s_idx AS o_s, r.s_t AS o_st, r.l_idx AS o_l, r.l_t AS o_lt, r.moving AS o_moving, r.scored AS o_scored, {learn}, {stop_of("fl")} AS stop,
  r.open AND f.t - r.l_t >= {gate.still} AND f.sm <= stop AS ends, r.open AND NOT ends AS goes, f.sm > {start_of("fl")} / {gate.factor}::DOUBLE AS hot, {armed} AS armed, CASE WHEN armed AND hot THEN r.hits + 1 ELSE 0 END AS hits0,
  {vote} AS votes0, NOT goes AND armed AND hits0 >= {gate.debounce} AND {voted} AS starts, {forced} AS cut, CAST(f.score > stop AS INTEGER) AS up, goes OR starts AS open1,
  CASE WHEN starts THEN 0 WHEN goes THEN r.hits ELSE hits0 END AS hits1, CASE WHEN starts THEN []::BOOLEAN[] WHEN goes THEN r.votes ELSE votes0 END AS votes1,
  CASE WHEN starts THEN f.b_idx WHEN cut THEN f.idx ELSE r.s_idx END AS s1, CASE WHEN starts THEN f.b_t WHEN cut THEN f.t ELSE r.s_t END AS st1,
  CASE WHEN starts OR cut OR f.sm > stop THEN f.idx ELSE r.l_idx END AS l1, CASE WHEN starts OR cut OR f.sm > stop THEN f.t ELSE r.l_t END AS lt1,
  CASE WHEN starts OR cut THEN up WHEN goes THEN r.moving + up ELSE r.moving END AS moving1, CASE WHEN starts OR cut THEN 1 WHEN goes THEN r.scored + 1 ELSE r.scored END AS scored1
  FROM {name} r JOIN {name}_f f ON f.session_id = r.session_id AND f.idx = r.idx + 1)),
{name}_last AS (SELECT * FROM {name} g WHERE NOT EXISTS (SELECT 1 FROM {name} h WHERE h.session_id = g.session_id AND h.idx = g.idx + 1)),
{name}_all AS (SELECT session_id, e_start AS start_idx, e_end AS end_idx, e_start_t AS start_t, e_end_t AS end_t, e_forced AS forced, e_share AS share FROM {name} WHERE e_start IS NOT NULL
  UNION ALL SELECT session_id, s_idx, l_idx, s_t, l_t, false, moving / scored::DOUBLE FROM {name}_last WHERE open),
{name}_clips AS (SELECT session_id, start_idx, end_idx, start_t, end_t, forced, round(share, 6) AS moving_fraction, end_t - start_t >= {gate.least} AND share >= {gate.fraction}::DOUBLE AS accepted FROM {name}_all)"""


def clips_sql(gate: Gate) -> str:
    return f"WITH RECURSIVE {FRAMES}, {gate_sql(gate)} SELECT * FROM g_clips"
