"""Clips and triggers looked up in running totals, held against every frame of the session."""

from __future__ import annotations

import random

import pytest

from clipflow.operators import segment as S

SEC = 1_000_000
STOP = 1.0


@pytest.fixture(scope="module")
def frames():
    """Two sessions with missing frame numbers, null scores and frames of equal time."""
    draw, out = random.Random(3), []
    for s in (1, 2):
        t = 0
        for i in range(200):
            t += draw.choice([0, SEC, SEC, 3 * SEC])
            if draw.random() < 0.9:
                out.append((s, i, t, None if draw.random() < 0.1 else draw.choice([0.2, 0.9, 1.0, 1.3, 2.0])))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "session_id long, idx long, t long, score double")


def unequal(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and any(op in line for op in ("<=", ">=", " < ", " > "))]


def test_moving_fraction(spark, frames):
    numbers = {s: [i for z, i, *_ in frames if z == s] for s in (1, 2)}
    draw = random.Random(4)
    clips = [(s, *sorted(draw.sample(numbers[s], 2)), k) for k in range(60) for s in (1, 2)] + [(1, numbers[1][0], numbers[1][0], 99), (3, 0, 5, 0)]
    df = spark.createDataFrame(clips, "session_id long, start_idx long, end_idx long, k long")
    got = S.moving_fraction(df, table(spark, frames), STOP)
    assert not unequal(got)

    def by_hand(s, a, b):
        scores = [x for z, i, _, x in frames if z == s and a <= i <= b and x is not None]
        return round(sum(x > STOP for x in scores) / len(scores), 6) if scores else 1.0

    assert {tuple(r) for r in got.collect()} == {(*c, by_hand(*c[:3])) for c in clips if c[0] != 3}


def test_onset(spark, frames):
    triggers = [(s, i) for s, i, *_ in frames]
    got = S.motion_onset(spark.createDataFrame(triggers, "session_id long, trigger_idx long"), table(spark, frames), STOP, ring=20, quiet=2, lead=1)
    assert not unequal(got)

    def by_hand(s, k):
        own = [(i, x) for z, i, _, x in frames if z == s]
        low = max(0, k - 19)
        ends = [i for (_, x), (i, y) in zip(own, own[1:], strict=False) if x is not None and y is not None and max(x, y) <= STOP and i <= k and i - 1 >= low]
        return max(low, (min(max(ends) + 1, k) if ends else low) - 1)

    assert {tuple(r) for r in got.collect()} == {(s, k, by_hand(s, k)) for s, k in triggers}


def test_time_rule_ends_at_the_first_late_frame(spark, frames):
    rows = [f for f in frames if f[3] is not None]
    got = S.segments_by_time(table(spark, rows), 1.2, STOP, 2 * SEC, 0)
    assert not unequal(got)
    clips = S.segments(table(spark, rows), 1.2, STOP, 1, 2 * SEC, "score").collect()
    want = set()
    for c in clips:
        late = [(i, t) for s, i, t, _ in rows if s == c.session_id and t >= c.end_t + 2 * SEC]
        if late:
            want.add((c.session_id, c.start_idx, min(late)[0], min(late)[1] - c.start_t))
    assert want and {tuple(r) for r in got.collect()} == want
