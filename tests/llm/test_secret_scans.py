"""The network of the secret scans: fitted at every size, split by finding, its recall kept, whole runs judged in linear time."""

import random
import time

import numpy as np
import pytest

from clipflow.llm import secret_scans as S


@pytest.fixture(scope="module")
def net(spark):
    return S.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_fitted_on_the_smallest_table_with_recall(net):
    apart = [(S.windows(r, a, b), label) for r, a, b, label in S.labelled_set() if S.finding(r[a:b]) % S.APART == 0]
    found = S.EDGES[S.bins(net, [w for w, _ in apart])] >= net.threshold
    label = np.array([label for _, label in apart])
    assert len(apart) > 300 and found[label == 1].mean() >= S.RECALL and found[label == 0].mean() < 0.02


def test_fitted_on_an_empty_table(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    assert 0 < S.fit(docs).threshold < 1


def test_adds_secrets_that_no_rule_knows_and_leaves_prose(net):
    rng = random.Random(3)
    tokens = ["ghp_" + "".join(rng.choice(S.ALNUM) for _ in range(36)) for _ in range(50)]
    got = list(S.spans_of([f"use this one: {t} and go on" for t in tokens], net))
    assert all(not base for base, _, _ in got) and sum(len(spans) for _, spans, _ in got) >= 48
    plain = ["The meeting on 2024-05-06 is at //www.example.com/rooms/second-floor as always.", "Donaudampfschiffahrtsgesellschaft: Kapitaene", "version: 1.20.3", None, ""]
    assert sum(len(spans) for _, spans, _ in S.spans_of(plain, net)) == 0


def test_known_candidates_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        raw = "".join(rng.choice(["secret=abcdefg ", "0123456789abcdef" * 2, " ", "x-y_z/longerrunofletters", ": value12 ", "AKIA" + "Q" * 18]) for _ in range(rng.randint(1, 9))).encode()
        base, near = S.find(raw)
        assert near == sorted(near) and base == sorted(base)
        for a, b, known in near:
            want = 2 if any(x <= a and b <= y for x, _, y in base) else int(any(x < b and a < y for x, _, y in base))
            assert known == want, (raw, a, b)


def test_ten_megabytes_of_keys_in_linear_time(net):
    raw = b" ".join(b"token=%024dxyz" % i for i in range(280_000))
    began = time.time()
    base, near = S.find(raw)
    assert len(raw) > 9_000_000 and len(base) >= 280_000 and len(near) == 280_000 and time.time() - began < 20


def test_a_very_long_run_is_one_candidate(net):
    text = "key " + "Ab9" * 60_000 + " end"
    (_, spans, _), = S.spans_of([text], net)
    assert [s for s in spans if s[1] == 3] in ([], [(4, 3, 4 + 180_000)])


def test_all_windows_of_a_finding_are_on_one_side(spark):
    docs = spark.createDataFrame([(f"{w} password = Zk39dkQpLm77 and token: abcdefghijklmno{i}pq",) for w in ("one", "two") for i in range(40)], "t string")
    sides = {}
    for r in S.candidates(docs, "t").collect():
        sides.setdefault(r.value, set()).add(r.value % S.APART == 0)
    assert len(sides) == 41 and all(len(s) == 1 for s in sides.values())
