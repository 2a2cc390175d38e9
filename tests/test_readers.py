"""Readers on bad, blank and missing input, and the guards of a comparison."""

import json

import pytest

from clipflow.operators import manifest as A
from clipflow.sources import readers as R
from clipflow.sources import sinks as K


def test_manifest(spark, tmp_path):
    good = '{"line": 1, "id": "a", "reference": "x"}\n\n   \n{"line": 2, "id": "a", "reference": "y"}\n'
    (tmp_path / "good.jsonl").write_text(good)
    assert [r.reference for r in R.read_manifest(spark, str(tmp_path / "good.jsonl")).collect()] == ["y"]
    (tmp_path / "bad.jsonl").write_text(good + "{not a record\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(FileNotFoundError):
        R.read_manifest(spark, str(tmp_path / "none.jsonl"))


def test_hand_presence(spark, tmp_path):
    (tmp_path / "hands.jsonl").write_text('{"i": 0, "n_hands": 2}\n{"i": 1, "n_hands": 0, "phase": "SIGN"}\n')
    assert [tuple(r) for r in R.read_hand_presence(spark, str(tmp_path / "hands.jsonl")).orderBy("idx").collect()] == [(0, True), (1, False)]
    assert R.read_hand_presence(spark, str(tmp_path / "none.jsonl")) is None


def test_runs_that_cannot_be_compared(spark):
    run = lambda *rows: spark.createDataFrame(rows, "id string, reference string, hypothesis string")
    a = run(("1", "r", "x"), ("2", "s", "y"))
    assert A.checked(a, run(("1", "r", "z"), ("2", "s", "y"))).count() == 2
    with pytest.warns(UserWarning, match="2 and 1 clips, 1 shared"):
        assert A.checked(a, run(("1", "r", "z"))).count() == 1
    with pytest.raises(ValueError, match="no clips in common"):
        A.checked(a, run(("9", "r", "z")))
    with pytest.raises(ValueError, match="different references"):
        A.checked(a, run(("1", "other", "z")))


def test_a_run_in_parts(spark, tmp_path, monkeypatch):
    rows = [(f"r{i % 2}", f"d{i}", "c", "x" * 400, None if i == 3 else f"h{i}", i / 2) for i in range(60)]
    outputs = spark.createDataFrame(rows, "run string, id string, category string, reference string, hypothesis string, seconds double")
    config = spark.createDataFrame([("r0", {"beam": "4"}), ("r1", {})], "run string, config map<string,string>")
    monkeypatch.setattr(K, "PART_LETTERS", 2000)
    K.write_runs(outputs, config, str(tmp_path / "runs"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "runs")).collect()]
    assert len(lines) > 8 and max(len(x["outputs"]) for x in lines) < 15  # one line of 30 outputs a run before
    (tmp_path / "runs" / "part-old.txt").write_text('{"tag": "old", "beam": "5", "outputs": [{"id": "a", "hypothesis": "b"}]}\n')
    got, found = R.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(tuple(r) for r in got.collect() if r.run != "old") == sorted(rows, key=lambda r: r[:2])
    assert {r.run: r.config for r in found.collect()} == {"r0": {"beam": "4"}, "r1": {}, "old": {"beam": "5"}} and got.count() == 61
