"""The session gate as one pure step function, used by batch folds and by streams alike.

A state is a plain dictionary that JSON can hold. ``advance`` takes it with one frame and returns the clips that this frame ends.
Times are microseconds; scores that are null are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gate:
    start: float = 1.74
    stop: float = 0.29
    smooth: int = 15
    debounce: int = 3
    still: int = 2_500_000
    cap: int | None = None
    least: int = 1_000_000
    fraction: float = 0.5
    #: Presence vote: k of the last n, no vote if k is 0.
    vote_k: int = 0
    vote_n: int = 5
    #: Noise floor instead of fixed thresholds.
    adaptive: bool = False
    bootstrap: int = 60
    window: int = 300
    quiet_frames: int = 60
    stale: int = 15_000_000
    #: The start threshold is divided by this, and, if ``gated_vote``, only frames above it are looked at for presence: others count as absent.
    factor: float = 1.0
    gated_vote: bool = False
    #: Start, stop and noise floor (or None) of a calibration profile; the gate is armed after ``arming`` frames.
    profile: tuple[float, float, float | None] | None = None
    arming: int = 60
    #: Ring of raw scores for the back-dated onset; 0: clips begin at their trigger.
    ring: int = 0
    ring_quiet: int = 9
    lead: int = 7


#: Fixed values of the noise floor: multiples for start and stop, quiet bound, step of relaxation, least floor, bootstrap percentile, most drift.
START_TIMES, STOP_TIMES, QUIET_TIMES, RELAX, FLOOR, BOOT, DRIFT = 9.0, 1.5, 1.5, 1.5, 0.02, 0.10, 1.4


def new_state() -> dict:
    return {"recent": [], "samples": [], "floor": None, "boot": True, "quiet": 0, "relax": 1.0, "quiet_t": None, "hits": 0, "votes": [], "ring": [], "seen": 0, "clip": None}


def thresholds(gate: Gate, state: dict) -> tuple[float, float]:
    """A profile's, times its drift; else multiples of the noise floor; else fixed ones."""
    if gate.profile is not None:
        start, stop, floor = gate.profile
        drift = min(DRIFT, max(1 / DRIFT, state["floor"] / floor)) if floor and state["floor"] is not None else 1.0
        return start * drift, stop * drift
    if gate.adaptive and state["floor"] is not None:
        return state["floor"] * START_TIMES, state["floor"] * STOP_TIMES
    return gate.start, gate.stop


def median(values: list[float]) -> float:
    v, n = sorted(values), len(values)
    return (v[(n - 1) // 2] + v[n // 2]) / 2


def learn(gate: Gate, state: dict, smoothed: float, t: int) -> None:
    """Let an idle frame move the noise floor: at first all do (with a profile, none), later only frames of a long quiet run."""
    samples = state["samples"]
    if state["boot"] and gate.profile is None:
        samples.append(smoothed)
        state["quiet_t"] = t
        if len(samples) >= gate.bootstrap:
            state["floor"] = max(FLOOR, sorted(samples)[round(BOOT * (len(samples) - 1))])
            state["boot"] = False
        return
    if smoothed > thresholds(gate, state)[1] * QUIET_TIMES * state["relax"]:
        state["quiet"] = 0
        if state["quiet_t"] is not None and t - state["quiet_t"] > gate.stale:
            state["relax"] *= RELAX
            state["quiet_t"] = t
        return
    state["quiet"] += 1
    if state["quiet"] >= gate.quiet_frames:
        samples.append(smoothed)
        del samples[: -gate.window]
        state["quiet_t"], state["relax"], state["floor"] = t, 1.0, max(FLOOR, median(samples))


def onset(gate: Gate, state: dict, stop: float) -> tuple[int, int]:
    """Index and time at which the clip that is triggered now begins."""
    ring = state["ring"]
    at = 0
    for end in range(len(ring), gate.ring_quiet - 1, -1):
        if all(s <= stop for _, _, s in ring[end - gate.ring_quiet : end]):
            at = min(end, len(ring) - 1)
            break
    begin = ring[max(0, at - gate.lead)]
    return begin[0], begin[1]


def closed(gate: Gate, clip: dict, end_idx: int, end_t: int, forced: bool) -> dict:
    share = clip["moving"] / clip["scored"] if clip["scored"] else 1.0
    return {
        "start_idx": clip["start_idx"], "end_idx": end_idx, "start_t": clip["start_t"], "end_t": end_t, "forced": forced, "moving_fraction": round(share, 6),
        "accepted": end_t - clip["start_t"] >= gate.least and share >= gate.fraction,
    }


def advance(gate: Gate, state: dict, idx: int, t: int, score: float | None, present: bool | None = None) -> list[dict]:
    if score is None:
        return []
    recent = state["recent"]
    recent.append(score)
    del recent[: -gate.smooth]
    smoothed = round(sum(recent) / len(recent), 6)
    clip = state["clip"]
    state["seen"] += 1
    if (gate.adaptive or gate.profile is not None) and clip is None:
        learn(gate, state, smoothed, t)
    start, stop = thresholds(gate, state)
    if gate.ring:
        state["ring"].append((idx, t, score))
        del state["ring"][: -gate.ring]
    out = []
    if clip is not None and t - clip["last_t"] >= gate.still and smoothed <= stop:
        out.append(closed(gate, clip, clip["last_idx"], clip["last_t"], False))
        clip = state["clip"] = None
    if clip is None:
        armed = state["seen"] >= gate.arming if gate.profile is not None else not gate.adaptive or state["floor"] is not None
        hot = smoothed > start / gate.factor
        state["hits"] = state["hits"] + 1 if armed and hot else 0
        voted = True
        if gate.vote_k:
            state["votes"].append(bool(present) and (hot or not gate.gated_vote))
            del state["votes"][: -gate.vote_n]
            voted = sum(state["votes"]) >= gate.vote_k
        if armed and state["hits"] >= gate.debounce and voted:
            begin = onset(gate, state, stop) if gate.ring else (idx, t)
            state["clip"] = {"start_idx": begin[0], "start_t": begin[1], "last_idx": idx, "last_t": t, "moving": int(score > stop), "scored": 1}
            state["hits"], state["votes"] = 0, []
        return out
    clip["scored"] += 1
    clip["moving"] += score > stop
    if smoothed > stop:
        clip["last_idx"], clip["last_t"] = idx, t
    if gate.cap is not None and t - clip["start_t"] >= gate.cap:
        out.append(closed(gate, clip, idx, t, True))
        state["clip"] = {"start_idx": idx, "start_t": t, "last_idx": idx, "last_t": t, "moving": int(score > stop), "scored": 1}
    return out


def finish(gate: Gate, state: dict) -> list[dict]:
    """The clip that is open at the end of the input."""
    clip, state["clip"] = state["clip"], None
    return [closed(gate, clip, clip["last_idx"], clip["last_t"], False)] if clip else []
