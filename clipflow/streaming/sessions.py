"""Sessions of a stream with event time: frames put in order, ends by timer, a drain, and a count of what came too late.

State is kept by session, for a hash group of sessions at a time. Frames that arrive before their turn wait in a map keyed by index, one entry a frame, stored as arrays; what
has been released is not kept, so the map holds no more than the disorder within the watermark's delay. When the watermark has passed a waiting
frame, those before it can't come any more: the gap is given up and the frame is released. A session ends when the watermark is
``idle`` past its last frame; then its open clip is flushed, once, and its state is removed. Frames behind the watermark are dropped
by Spark and counted (``Drained.late``). A session that goes on after its end begins anew.

The watermark stops with the last frame. ``drained`` ends a stream by landing one marker row far ahead in time, which no session
sees but which lets every timer run out.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from clipflow.streaming import machine as M
from clipflow.streaming.folds import CLIP

FRAME = ["session_id", "idx", "t", "score", "present"]
#: index of a marker row, and how far ahead of the last frame it lies.
MARKER, AHEAD = -1, 50 * 365 * 86_400_000_000


#: Sessions are dealt over so many groups; null sessions are one more. A call of Python for each session would take longer than its frames.
BUCKETS = 1 << 13
#: A group's state between two calls. Of each session: what ``step`` keeps (bounded by its rings), its place and how many frames wait; then all those frames.
STATE = "session array<{}>, own array<string>, next array<long>, last_t array<long>, due array<long>, waiting array<int>, idx array<long>, t array<long>, score array<double>, present array<boolean>"


class Value:
    """One value of the session at hand."""

    def __init__(self, value: tuple | None = None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None


class Waiting(dict):
    """The frames of the session at hand that wait for their turn, by index."""

    exists = lambda self: len(self) > 0
    iterator = dict.items
    updateValue, removeKey = dict.__setitem__, dict.__delitem__


class Timers:
    """The session's one timer is part of its place; the first one of a group is set as its timeout at the end of each call."""

    def registerTimer(self, due: int) -> None:
        pass

    deleteTimer = registerTimer


class Session:
    """Puts a session's frames in order and folds ``step`` over them; ``end`` gives the last rows when the session is over.

    State comes with a group's rows and goes back with the result: a call for each frame or value would cost a round trip to the executor.
    """

    def __init__(self, start: Callable[[], dict], step: Callable[[dict, dict], list[dict]], end: Callable[[dict], list[dict]], columns: list[str], idle: int):
        self.start, self.step, self.end, self.columns, self.idle = start, step, end, columns, idle
        self.handle = Timers()

    def called(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One group: the sessions that have new frames, and those whose timer is due."""
        arrived: dict = {}
        for batch in batches:
            known = lambda c: [None if x is None or x != x else x for x in batch[c].tolist()]  # noqa: E731, B023
            for session, i, t, score, present in zip(known("session_id"), batch["idx"].tolist(), batch["t"].tolist(), known("score"), known("present"), strict=True):
                if i != MARKER:
                    arrived.setdefault(session, {})[int(i)] = (int(t), score, present)
        if not arrived and not state.exists:
            return
        kept, watermark, out = self.loaded(state.get) if state.exists else {}, state.getCurrentWatermarkMs(), []
        for session in [*kept, *(s for s in arrived if s not in kept)]:
            self.own, self.place, self.held = kept.get(session) or (Value(), Value(), Waiting())
            if session in arrived or self.place.get()[2] <= watermark:
                out += self.released((session,), arrived.get(session, {}), watermark * 1000)
                kept[session] = self.own, self.place, self.held
                if not self.place.exists():
                    del kept[session]
        if kept:
            state.update(self.stored(kept))
            state.setTimeoutTimestamp(max(min(place.get()[2] for _, place, _ in kept.values()) - 1, watermark, 1))  # runs out when the watermark is past it
        elif state.exists:
            state.remove()
        if out:
            yield self.framed(out)

    def loaded(self, stored: tuple) -> dict:
        """The sessions of a group's state."""
        session, own, next_, last_t, due, waiting, *frames = stored
        each = (((i,), frame) for i, *frame in zip(*frames, strict=True))
        return {s: (Value((o,)), Value((n, t, d)), Waiting(islice(each, w))) for s, o, n, t, d, w in zip(session, own, next_, last_t, due, waiting, strict=True)}

    def stored(self, kept: dict) -> tuple:
        each = [(session, *own.get(), *place.get(), len(held)) for session, (own, place, held) in kept.items()]
        frames = [(i, *frame) for _, _, held in kept.values() for (i,), frame in held.items()]
        return (*map(list, zip(*each, strict=True)), *(map(list, zip(*frames, strict=True)) if frames else ([], [], [], [])))

    def framed(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: [r.get(c) for r in rows] for c in self.columns})

    def advanced(self, key, arrived: dict, watermark: int | None) -> pd.DataFrame:
        return self.framed(self.released(key, arrived, watermark))

    def released(self, key, arrived: dict, watermark: int | None) -> list[dict]:
        """Of the session at hand release what is next; with a ``watermark``, also what waits for frames that can't come, and the end of the session."""
        next_, last_t, timer = self.place.get() if self.place.exists() else (0, None, None)
        state = json.loads(self.own.get()[0]) if self.own.exists() else self.start()
        waiting = {k[0]: v for k, v in self.held.iterator()} if self.held.exists() else {}
        stored = set(waiting)
        waiting |= {i: v for i, v in arrived.items() if i >= next_}
        out = []
        for i in sorted(waiting):
            t, score, present = waiting[i]
            if i != next_ and (watermark is None or t >= watermark):
                break
            out += self.step(state, {"idx": i, "t": t, "score": score, "present": present})
            next_, last_t = i + 1, t
            del waiting[i]
        for i in stored - set(waiting):
            self.held.removeKey((i,))
        for i in set(waiting) - stored:
            self.held.updateValue((i,), waiting[i])
        over = watermark is not None and not waiting and last_t is not None and watermark >= last_t + self.idle
        due = None
        if over:
            out += self.end(state)
            for held in (self.own, self.place, self.held):
                held.clear()
        else:
            first = min((v[0] for v in waiting.values()), default=None)
            due = -(-(last_t + self.idle if first is None else first + 1) // 1000)
            self.own.update((json.dumps(state, default=lambda x: x.item()),))
            self.place.update((next_, last_t, due))
        if due != timer:
            if timer is not None and watermark is None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        return [{"session_id": key[0]} | r for r in out]


def sessions(frames: DataFrame, start, step, end, schema: str, delay: str, idle: int) -> DataFrame:
    """``step`` folded over each session of a stream of frames, which may arrive in any order within ``delay`` of the latest time seen."""
    columns = [c.split()[0] for c in schema.split(", ")]
    bucket = F.when(F.col("session_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)))
    timed = frames.select(*FRAME, F.timestamp_micros("t").alias("at"), bucket.alias("bucket")).withWatermark("at", delay)
    session, state = Session(start, step, end, columns, idle), STATE.format(frames.schema["session_id"].dataType.simpleString())
    return timed.groupBy("bucket").applyInPandasWithState(lambda *a: session.called(*a), schema, state, "append", "EventTimeTimeout")


def clips(frames: DataFrame, gate: M.Gate, delay: str, idle: int) -> DataFrame:
    """The gate's clips; a session's open clip comes with its end."""
    step = lambda s, r: M.advance(gate, s, r["idx"], r["t"], r["score"], r["present"])
    return sessions(frames, M.new_state, step, lambda s: M.finish(gate, s), CLIP, delay, idle)


def in_order(frames: DataFrame, delay: str, idle: int) -> DataFrame:
    """Each frame as it is released, with its number n; gaps end by the watermark and leave no number out."""

    def step(state, row):
        state["n"] += 1
        return [{"idx": row["idx"], "n": state["n"] - 1}]

    return sessions(frames, lambda: {"n": 0}, step, lambda s: [], "session_id long, idx long, n long", delay, idle)


class Late(StreamingQueryListener):
    """Adds up the rows that one query drops behind its watermark."""

    def __init__(self):
        self.id, self.rows, self.over = None, 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.id:
            self.rows += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.id:
            self.over.set()


@contextmanager
def rocksdb(spark: SparkSession):
    """A state store that keeps state outside the heap, for queries started inside."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@dataclass
class Drained:
    rows: DataFrame
    late: int


def run(build: Callable[[DataFrame], DataFrame], source: str, schema: str, out: str, files: int) -> tuple[T.StructType, Late]:
    """Everything that ``source`` holds and that the checkpoint below ``out`` has not seen, ``files`` files a batch, appended to ``out``."""
    spark, late = SparkSession.active(), Late()
    spark.streams.addListener(late)
    try:
        with rocksdb(spark):
            frames = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source))
            q = frames.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            late.id = str(q.runId)
            q.awaitTermination()
        late.over.wait(30)
    finally:
        spark.streams.removeListener(late)
    return frames.schema, late


def drained(spark: SparkSession, source: str, schema: str, build: Callable[[DataFrame], DataFrame], out: str, files: int = 1) -> Drained:
    """Run a stream over the Parquet files of ``source`` until all are read, then end it: a marker lands in ``source``, all timers run
    out, and sessions that are still open are flushed. Returns what it wrote and how many frames were too late."""
    kind, first = run(build, source, schema, out, files)
    last = spark.read.schema(schema).parquet(source).agg(F.max("t")).first()[0]
    if last is not None:
        spark.createDataFrame([(None, MARKER, last + AHEAD, None, None)], schema).select(*FRAME).coalesce(1).write.mode("append").parquet(source)
    _, second = run(build, source, schema, out, files)
    return Drained(spark.read.schema(kind).parquet(f"{out}/data"), first.rows + second.rows)
