"""Streams with event time: order, gaps, ends by timer, late frames; newest wins; the ledger and its torn last record."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from clipflow.sources import ledger as L
from clipflow.streaming import folds as D
from clipflow.streaming import machine as M
from clipflow.streaming import newest as N
from clipflow.streaming import sessions as S

SEC = 1_000_000
COLUMNS = "session_id long, idx long, t long, score double, present boolean"
GATE = M.Gate(start=1.6, stop=1.1, smooth=2, debounce=2, still=3 * SEC, least=SEC, cap=6 * SEC)
LONG = 10**9 * SEC


def frames_of(rng, n, session):
    t, out = rng.randint(0, 5) * SEC, []
    for i in range(n):
        t += rng.choice([1, 1, 1, 2, 8]) * SEC // 2
        out.append((session, i, t, round(rng.random() * 3, 2), rng.random() < 0.5))
    return out


def land(spark, path, files):
    """Files in the order given, each its own batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):  # later files have later times
            full = f"{path}/{f}"
            if f.endswith(".parquet") and os.path.getmtime(full) > 10**9 + 10**6:
                os.utime(full, (10**9 + i, 10**9 + i))


def shuffled(rows, rng, width):
    """Frames in the order of their times, moved by up to ``width``, cut into four files."""
    moved = sorted(rows, key=lambda r: r[2] + rng.random() * width)
    n = -(-len(moved) // 4)
    return [moved[i : i + n] for i in range(0, len(moved), n)]


@pytest.fixture(autouse=True)
def two_partitions(spark):
    """A state store and a worker for each partition and batch are what these tests' time goes to."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [r for s in range(25) for r in frames_of(rng, rng.randint(1, 60), s)]


def test_stream_is_the_batch_with_the_last_clip(spark, rows, tmp_path):
    path = f"{tmp_path}/in"
    land(spark, path, shuffled(rows, random.Random(1), 4 * SEC))
    got = S.drained(spark, path, COLUMNS, lambda d: S.clips(d, GATE, "20 seconds", LONG), f"{tmp_path}/out")
    want = D.clips(spark.createDataFrame(rows, COLUMNS), GATE)
    open_ = want.exceptAll(D.clips(spark.createDataFrame(rows, COLUMNS), GATE, flush=False)).count()
    assert open_ > 0 and want.where("forced").count() > 0 and got.late == 0
    assert sorted(map(tuple, got.rows.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_close_by_timer_and_go_on_anew(spark, tmp_path):
    """A session idle for 60 s is over before the stream is: its clip is out when the next batch has passed, and later frames are a new session."""
    first = [(1, i, (1 + i) * SEC, 3.0, True) for i in range(10)]
    other = [(2, i, (100 + i) * SEC, 0.0, True) for i in range(10)]
    again = [(1, i, (300 + i) * SEC, 3.0, True) for i in range(5)]
    path, gate = f"{tmp_path}/in", M.Gate(start=1.0, stop=0.5, smooth=1, debounce=1, still=3 * SEC, least=0)
    land(spark, path, [first, other])
    S.run(lambda d: S.clips(d, gate, "1 second", 60 * SEC), path, COLUMNS, f"{tmp_path}/out", 1)
    early = spark.read.schema(D.CLIP).parquet(f"{tmp_path}/out/data").collect()
    assert [(r.session_id, r.start_idx, r.end_idx) for r in early] == [(1, 0, 9)]
    land(spark, path, [again])
    got = S.drained(spark, path, COLUMNS, lambda d: S.clips(d, gate, "1 second", 60 * SEC), f"{tmp_path}/out")
    assert sorted((r.session_id, r.start_t // SEC, r.end_t // SEC) for r in got.rows.collect()) == [(1, 1, 10), (1, 300, 304)]


def test_gaps_end_and_late_frames_are_counted(spark, tmp_path):
    """Index 3 never comes, 6 comes too late: the others are released in order, numbered without a gap."""
    at = lambda i: (7, i, (1 + i) * SEC, float(i), None)
    files = [[at(1), at(0), at(2)], [at(5), at(4)], [at(9), at(8), at(7)], [at(40)], [at(60)], [at(6), at(61)]]
    path = f"{tmp_path}/in"
    land(spark, path, files)
    got = S.drained(spark, path, COLUMNS, lambda d: S.in_order(d, "5 seconds", LONG), f"{tmp_path}/out")
    found = sorted((r.n, r.idx) for r in got.rows.collect())
    assert [i for _, i in found] == [0, 1, 2, 4, 5, 7, 8, 9, 40, 60, 61] and [n for n, _ in found] == list(range(11))
    assert got.late == 1


def test_waiting_frames_are_all_that_the_map_holds(spark, rows):
    """The reorder map after each batch, against the frames that have arrived and not been released."""

    class Value(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)

    class Map(dict):
        exists = lambda self: bool(self)
        iterator = lambda self: iter(list(self.items()))
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        timers = set()

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    rng = random.Random(2)
    p = S.Session(lambda: {"n": 0}, lambda s, r: [{"idx": r["idx"]}], lambda s: [], ["session_id", "idx"], LONG)
    p.handle, p.own, p.place, p.held = Handle(), Value(), Value(), Map()
    order = list(range(500))
    moved = sorted(order, key=lambda i: i + rng.random() * 20)
    seen, out = set(), []
    for at in range(0, 500, 10):
        batch = moved[at : at + 10]
        seen |= set(batch)
        out += p.advanced((1,), {i: (i * SEC, 0.0, None) for i in batch}, None)["idx"].tolist()
        assert set(p.held) == {(i,) for i in seen - set(out)} and len(p.held) <= 30
        assert len(p.handle.timers) == 1
    assert out == order and not p.held


def test_state_of_many_sessions_is_written_once_a_call():
    """Three sessions of one group, one with a gap: one read and one write a call; the gap ends when its timer is due, the other sessions are as they were."""
    import pandas as pd

    class State:
        hasTimedOut, value, wm, writes, due = False, None, 0, 0, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        getCurrentWatermarkMs = lambda self: self.wm
        setTimeoutTimestamp = lambda self, t: setattr(self, "due", t)

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

        def remove(self):
            self.value = None

    frames_ = lambda rows: iter([pd.DataFrame(rows, columns=S.FRAME)])
    step = lambda s, r: [{"idx": r["idx"], "score": r["score"], "present": r["present"]}]
    p, state = S.Session(lambda: {"n": 0}, step, lambda s: [{"idx": -9}], ["session_id", "idx", "score", "present"], 100 * SEC), State()
    first = [(7, 0, SEC, 0.5, True), (7, 2, 3 * SEC, None, None), (7, 3, 4 * SEC, 1.5, False), (8, 1, 2 * SEC, 2.0, True), (9, 0, SEC, 3.0, None)]
    got = next(p.called((1,), frames_(first), state))
    assert sorted(zip(got.session_id, got.idx, strict=True)) == [(7, 0), (9, 0)] and state.writes == 1 and state.due == 2000  # 8 waits from 2 s on
    state.wm, state.hasTimedOut = 2500, True
    got = next(p.called((1,), iter([]), state))
    assert list(zip(got.session_id, got.idx, strict=True)) == [(8, 1)] and state.writes == 2 and state.due == 3000
    state.wm = 5000
    got = next(p.called((1,), frames_([(9, 1, 6 * SEC, 4.0, True), (None, S.MARKER, 0, None, None)]), state))
    rows = [(s, i, None if x is None or x != x else x, y) for s, i, x, y in got.itertuples(index=False)]
    assert sorted(rows, key=lambda r: r[:2]) == [(7, 2, None, None), (7, 3, 1.5, False), (9, 1, 4.0, True)] and state.writes == 3
    state.wm = 10**9
    assert sorted(next(p.called((1,), iter([]), state)).session_id) == [7, 8, 9] and state.value is None  # all are over
    assert list(p.called((1,), frames_([(None, S.MARKER, 0, None, None)]), state)) == [] and state.value is None


# newest


def test_newest_over_batches_repeats_and_order(spark, rows, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    land(spark, path, shuffled(rows, random.Random(3), 60 * SEC))
    source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(path)
    N.run(source, out, f"{tmp_path}/state")
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) >= 4
    want = {}
    for r in rows:
        want[r[0]] = max(want.get(r[0], r), r, key=lambda x: (x[2], x[1]))
    same = lambda: {(r.session_id, r.idx, r.t, r.score, r.present) for r in N.read(spark, out, COLUMNS).collect()} == set(want.values())
    assert same()
    N.upsert(spark.createDataFrame(shuffled(rows, random.Random(3), 60 * SEC)[1], COLUMNS), 1, out)  # the second batch again
    assert same()
    N.compact(spark, out, COLUMNS, f"{tmp_path}/base")
    assert {tuple(r) for r in N.read(spark, f"{tmp_path}/base", COLUMNS).select("session_id", "idx", "t", "score", "present").collect()} == set(want.values())


# ledger

RECORD = "id string, hypothesis string, seconds double"


def test_ledger_cut_at_every_byte(spark, tmp_path):
    """However much of its last line is there, exactly the other records are; the whole line without its end of line is a record."""
    records = [{"id": f"d{i}", "hypothesis": 'größe, "{x}" 1}', "seconds": 1.5 * i} for i in range(4)]
    whole = [json.dumps(r, ensure_ascii=False).encode() for r in records]
    last = whole[-1] + b"\n"
    for cut in range(len(last) + 1):
        os.makedirs(f"{tmp_path}/{cut:04d}")
        with open(f"{tmp_path}/{cut:04d}/part.txt", "wb") as f:
            f.write(b"\n".join(whole[:-1]) + b"\n" + last[:cut])
    held = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)).select("value", F.input_file_name().alias("file"))
    found = held.where(F.trim("value") != "").select("file", "value")
    by = {}
    assert L.lines(spark, str(tmp_path)).where("whole").count() == 3 * (len(last) + 1) + 2
    for r in found.join(L.lines(spark, str(tmp_path)).where("whole").select("value").distinct(), "value").collect():
        by.setdefault(r.file.split("/")[-2], []).append(json.loads(r.value)["id"])
    for cut in range(len(last) + 1):
        assert sorted(by[f"{cut:04d}"]) == ["d0", "d1", "d2"] + (["d3"] if cut >= len(whole[-1]) else [])
    assert {r.id for r in L.read(spark, f"{tmp_path}/0007", RECORD).collect()} == {"d0", "d1", "d2"}


def test_resume_after_a_stop(spark, tmp_path):
    """Batches of a stream, one repeated, one torn: the plan is to run what is missing, or refused under another configuration."""
    ledger, source = f"{tmp_path}/ledger", f"{tmp_path}/in"
    manifest = spark.createDataFrame([(f"d{i}", i) for i in range(12)], "id string, position long")
    wanted = spark.createDataFrame([("beam", "4"), ("stride", "2")], "key string, value string")
    assert {(r.id, r.action) for r in L.plan(manifest, spark, ledger, RECORD, wanted).collect()} == {(f"d{i}", "run") for i in range(12)}
    L.commit_config(spark, {"beam": 4, "stride": 2}, ledger)
    batches = [[(f"d{i}", "x", 1.0), (f"d{i + 1}", None, 2.0)] for i in (0, 2, 4)]
    for b in batches:
        spark.createDataFrame(b, RECORD).coalesce(1).write.mode("append").parquet(source)
    L.stream(spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(source), ledger, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    L.commit(spark.createDataFrame(batches[1], RECORD), 1, ledger)
    L.commit(spark.createDataFrame(batches[1], RECORD), 1, ledger)
    assert len(L.read(spark, ledger, RECORD).collect()) == 6
    with open(f"{ledger}/torn.txt", "w") as f:
        f.write('{"id":"d6","hypothesis":"whole","seconds":1.0}\n{"id":"d7","hypothesis":"cut sh')
    left = {f"d{i}" for i in range(7, 12)}
    assert {(r.id, r.action) for r in L.plan(manifest, spark, ledger, RECORD, wanted).collect()} == {(i, "run") for i in left}
    other = wanted.union(spark.createDataFrame([("jitter", "1")], "key string, value string"))  # a key that the ledger lacks counts
    assert {(r.id, r.action) for r in L.plan(manifest, spark, ledger, RECORD, other).collect()} == {(i, "refused") for i in left}
