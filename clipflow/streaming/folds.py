"""Folds of ordered sessions in batch; streaming/sessions.py runs the same steps as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from clipflow.streaming import machine as M

CLIP = "session_id long, start_idx long, end_idx long, start_t long, end_t long, forced boolean, moving_fraction double, accepted boolean"
KEEP = ["session_id", "idx", "t", "score", "present"]


def fold(df: DataFrame, step: Callable[[dict, dict], list[dict]], end: Callable[[dict], list[dict]], start: Callable[[], dict], schema: str, keep: list[str] = KEEP) -> DataFrame:
    """Run ``step`` over the frames of each session in order. Sessions are dealt by key, sorted and streamed through: a long one needs no more
    memory than a short one. ``end`` gives the last rows of a session."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, columns = None, None, [c.split()[0] for c in schema.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=columns)
        for batch in batches:
            out: list[dict] = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if row["session_id"] != session:
                    if state is not None:
                        out += [{"session_id": session} | r for r in end(state)]
                    session, state = row["session_id"], start()
                out += [{"session_id": session} | r for r in step(state, row)]
            if out:
                yield frame(out)
        if state is not None and (rows := [{"session_id": session} | r for r in end(state)]):
            yield frame(rows)

    return df.select(*keep).repartition("session_id").sortWithinPartitions("session_id", "idx").mapInPandas(run, schema)


def clips(df: DataFrame, gate: M.Gate, flush: bool = True) -> DataFrame:
    """The gate's clips; ``flush``: also those that are open at the end."""
    return fold(df, lambda s, r: M.advance(gate, s, r["idx"], r["t"], r["score"], r["present"]), (lambda s: M.finish(gate, s)) if flush else (lambda s: []), M.new_state, CLIP)


def bank(df: DataFrame, gates: dict[str, tuple[float, M.Gate]]) -> DataFrame:
    """The clips of many gates, each on scores times its scale, advanced together in one pass over each session: config and the columns of a clip."""

    def step(states, row):
        return [{"config": n} | c for n, (scale, g) in gates.items() for c in M.advance(g, states[n], row["idx"], row["t"], None if row["score"] is None else row["score"] * scale, row["present"])]

    def end(states):
        return [{"config": n} | c for n, (_, g) in gates.items() for c in M.finish(g, states[n])]

    return fold(df, step, end, lambda: {n: M.new_state() for n in gates}, CLIP.replace("session_id long", "session_id long, config string"))


def trigger_starts(df: DataFrame, threshold: float | None, smooth: int = 15, k: int = 3, n: int = 5, debounce: int = 3, arming: int = 2_000_000) -> DataFrame:
    """Per session and phase: how often the idle decision starts, and its frames. df: also phase, vt (time of the latest verdict) and verdict.

    A phase is its frames in order, wherever they stand in the session; the arming time runs from the session's first frame. With a
    ``threshold`` (pre-gated), verdicts are taken up only on frames whose smoothed score is above it, others vote absent, and a
    start needs ``debounce`` such frames in a row. Without, every new verdict votes and alone decides. A start clears the vote.
    """

    def step(state, row):
        state.setdefault("t0", row["t"])
        p = state["phases"].setdefault(row["phase"], {"recent": [], "votes": [], "above": 0, "starts": 0, "frames": 0, "vt": None})
        p["frames"] += 1
        p["recent"].append(row["score"])
        del p["recent"][:-smooth]
        hot = threshold is None or round(sum(p["recent"]) / len(p["recent"]), 6) > threshold
        p["above"] = p["above"] + 1 if hot else 0
        if hot and row["vt"] != p["vt"]:
            p["vt"] = row["vt"]
            p["votes"].append(bool(row["verdict"]))
        elif not hot:
            p["votes"].append(False)
        del p["votes"][:-n]
        if row["t"] - state["t0"] >= arming and sum(p["votes"]) >= k and (threshold is None or p["above"] >= debounce):
            p["starts"], p["votes"], p["above"] = p["starts"] + 1, [], 0
        return []

    end = lambda s: [{"phase": name, "starts": p["starts"], "frames": p["frames"]} for name, p in s["phases"].items()]
    return fold(df, step, end, lambda: {"phases": {}}, "session_id long, phase string, starts long, frames long", ["session_id", "idx", "t", "score", "phase", "vt", "verdict"])


def floors(df: DataFrame, gate: M.Gate) -> DataFrame:
    """The noise floor, the relaxation and the number of samples that each session ends with."""
    end = lambda s: [{"floor": s["floor"], "relax": s["relax"], "samples": len(s["samples"])}]
    return fold(df, lambda s, r: M.advance(gate, s, r["idx"], r["t"], r["score"]) and [], end, M.new_state, "session_id long, floor double, relax double, samples long")
