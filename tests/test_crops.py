"""Crops, problem lists and run figures by hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from clipflow.functions import boxes as B
from clipflow.operators import compare as C
from clipflow.operators import landmarks as L
from clipflow.operators import manifest as A


def test_crop_sources(spark):
    box = "box: struct<pose: boolean, hand: int>"
    rows = [(0, None), (1, (True, None)), (2, (True, 5)), (3, None), (4, (False, 7)), (5, None), (6, (True, None)), (7, None), (8, (True, 9))]
    d = L.crop_sources(spark.createDataFrame([("c", *r) for r in rows], f"clip string, frame int, {box}"), ["clip"], "frame", "box", ["hand"])
    got = [None if r.hand_crop is None else tuple(r.hand_crop) for r in d.orderBy("frame").collect()]
    # 3: the landmarks of 2 on the image of 3; 4 and 5: no pose; 6 and 7: no hand
    assert got == [None, None, (2, 5), (3, 5), (3, 5), (3, 5), (3, 5), (3, 5), (8, 9)]


def test_union_is_clamped_before_it_is_squared(spark):
    part = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    one = lambda *parts: tuple(spark.range(1).select(B.padded_union(list(parts), 100, 80).alias("u")).first().u)
    assert one(part(30, 40, 50, 45)) == (20, 23, 60, 62)  # 40 by 25: 7 above and below
    assert one(part(2, 40, 10, 45), part(40, 41, 50, 47)) == (0, 14, 60, 73)  # 60 by 27: 16 above and below
    assert one(part(95, 10, 99, 70)) == (53, 0, 100, 80)  # 15 by 80: 32 to the left, the edge to the right


def test_jitter_of_streams(spark):
    box = F.struct(F.lit(40).alias("x1"), F.lit(30).alias("y1"), F.lit(60).alias("x2"), F.lit(50).alias("y2"))
    d = spark.range(6).withColumn("stream", F.when(F.col("id") % 2 == 0, "left_hand").otherwise("mouth"))
    of = lambda **k: [tuple(r.b) for r in d.select("id", B.jittered(box, 5, F.col("stream"), F.col("id"), 0.2, 8.0, 100, 80, **k).alias("b")).orderBy("id").collect()]
    still = of(static=True, streams=("left_hand",))
    assert still[1::2] == [(40, 30, 60, 50)] * 3 and len(set(still[::2])) == 1 and still[0] != still[1]
    assert len(set(of(streams=("left_hand",))[::2])) == 3 and of()[1] != (40, 30, 60, 50)
    with pytest.raises(ValueError):
        of(streams=())


@pytest.mark.parametrize("paths", [["a.mp4", "xx/a.mp4", "b.mp4", "%.mp4", None], ["a", "", None], [None], []])
def test_problem_lines(spark, paths):
    lines = ["bad xx/a.mp4!", "", None, "a", "c.mp4 b.mp"]
    inputs = spark.createDataFrame([(p, 1) for p in paths], "path string, __other int")
    for some in (lines, []):
        got = A.not_named(inputs, spark.createDataFrame([(x,) for x in some], "line string"))
        assert got.columns == inputs.columns
        want = [p for p in paths if p is None or not any(x is not None and p in x for x in some)]
        assert sorted(map(str, (r.path for r in got.collect()))) == sorted(map(str, want))


def test_speeds_and_recalls(spark):
    d = spark.createDataFrame([("x", "a", 3000), ("x", "b", 1000), ("y", "a", 1000), ("y", "b", None), ("z", "b", 0)], "category string, run string, millis int")
    got = {r.category: tuple(r)[1:] for r in C.speeds(d).collect()}
    assert got == {"ALL": (2.0, 0.5, 4.0), "x": (3.0, 1.0, 3.0), "y": (1.0, None, None), "z": (None, 0.0, None)}
    n = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("b", 1.0)], "run string, best double")
    assert [tuple(r) for r in C.recalls(n).collect()] == [("proper_noun_recall", 50.0, 100.0, 50.0)]
    assert C.recalls(n.where("run = 'a'")).collect() == []
