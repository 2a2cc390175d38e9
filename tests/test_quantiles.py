"""Exact order statistics by ranges against sorted lists: ties, hot values, small and large groups, nulls."""

import math
import random

import pytest

from clipflow.functions import quantiles as Q

PICKS = {"a": (0.37, "linear"), "b": (0.37, "nearest"), "c": (0.99, "floor"), "d": (0.975, "ci"), "e": (0.0, "linear"), "f": (1.0, "linear")}


def by_hand(values, p, kind):
    v, n = sorted(values), len(values)
    if kind == "linear":
        at = p * (n - 1)
        low = v[math.floor(at)]
        return low + (at - math.floor(at)) * (v[math.ceil(at)] - low)
    k = {"nearest": lambda: round(p * (n - 1)), "floor": lambda: min(n - 1, int(p * n)), "ci": lambda: int(p * n)}[kind]()
    return v[k] if k < n else None


@pytest.mark.parametrize("ranges", [2, 7, 512])
def test_ranks_by_ranges(spark, ranges):
    rng = random.Random(6)
    groups = {
        "one": [4.0], "two": [2.0, 1.0], "same": [3.0] * 200, "hot": [5.0] * 700 + [rng.random() * 10 for _ in range(300)], "even": [rng.random() for _ in range(1500)],
        "ties": [float(rng.randint(0, 9)) for _ in range(400)], "negative": [-rng.random() for _ in range(50)] + [0.0, -0.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None)] * 20 + [("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in Q.picked(df, ["g"], "v", PICKS, ranges).collect()}
    assert {g for g in got if got[g].a is not None} == set(groups)
    for g, values in groups.items():
        for name, (p, kind) in PICKS.items():
            want = by_hand(values, p, kind)
            assert (got[g][name] is None and want is None) or got[g][name] == pytest.approx(want, abs=1e-12), (g, name)
