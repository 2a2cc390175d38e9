"""Overlaps of n-grams held against multisets of tuples, row by row."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from clipflow.functions import ngrams as N
from clipflow.operators import textmetrics as M


def by_hand(hyp, ref, orders):
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    both = [(grams(hyp, n), grams(ref, n)) for n in range(1, orders + 1)]
    return [sum((h & r).values()) for h, r in both] + [sum(h.values()) for h, _ in both] + [sum(r.values()) for _, r in both]


@pytest.fixture(scope="module")
def pairs():
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("ab é𝒳ß") for _ in range(n))
    return [(text(draw.randrange(40)), text(draw.randrange(40))) for _ in range(300)] + [("", ""), ("", "ab"), ("aaaa", "aa"), (text(5000), text(4000))]


def test_texts(pairs):
    got = N.overlap_columns(pa.array([h for h, _ in pairs]), pa.array([r for _, r in pairs]), 6)
    assert got.tolist() == [by_hand(h, r, 6) for h, r in pairs]


def test_tokens(pairs):
    words = [(h.split(" "), r.split(" ")) for h, r in pairs]
    got = N.overlap_columns(pa.array([h for h, _ in words]), pa.array([r for _, r in words]), 4)
    assert got.tolist() == [by_hand(h, r, 4) for h, r in words]


def test_nulls_and_slices():
    hyp, ref = pa.array(["x", None, "ab", "ab", None]), pa.array(["x", "ab", None, "abc", None])
    want = [by_hand(h or "", r or "", 3) for h, r in zip(hyp.to_pylist(), ref.to_pylist(), strict=True)]
    assert N.overlap_columns(hyp, ref, 3).tolist() == want
    assert N.overlap_columns(hyp.slice(2, 2), ref.slice(2, 2), 3).tolist() == want[2:4]
    lists = pa.array([["x"], None, ["a", "b"], []]), pa.array([None, ["a"], ["b", "a", "b"], []])
    want = [by_hand(h or [], r or [], 2) for h, r in zip(*(c.to_pylist() for c in lists), strict=True)]
    assert N.overlap_columns(*lists, 2).tolist() == want
    assert N.overlap_columns(lists[0].slice(1, 3), lists[1].slice(1, 3), 2).tolist() == want[1:]
    assert N.overlap_columns(hyp.slice(0, 0), ref.slice(0, 0), 3).shape == (0, 9)


def test_parts_keep_the_order():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * (i % 50) for i in range(1000)]})
    got = list(N.parts(batch, 500))
    assert pa.Table.from_batches(got).column("t").to_pylist() == batch.column("t").to_pylist()
    assert len(got) > 50 and max(p.nbytes for p in got if p.num_rows > 1) <= 500


def test_columns_of_a_table(spark):
    rows = [(1, "a b c, a b", "a b c"), (2, "", "x y"), (3, None, "x y"), (4, "x y z w", "x y z w"), (4, "x y z w", "x y z w")]
    df = spark.createDataFrame(rows, "id long, hyp string, ref string")
    got = {r["id"]: r for r in M.all_stats(df, ["id"], "hyp", "ref", df["id"] != 4).collect()}
    assert [got[1][f"m{n}"] for n in range(1, 5)] == [3, 2, 1, 0] and got[1]["hyp_len"] == 6 and got[1]["ref_len"] == 3
    assert got[2]["hyp_len"] == 0 and got[3]["hyp_len"] == 0 and got[3]["ref_len"] == 2
    assert got[4]["m4"] == 1 and got[4]["cm1"] == 0 and got[2]["cr1"] == 2
    assert M.all_stats(df, ["id"], "hyp", "ref", df["id"] > 0).count() == 5
    assert M.all_stats(df.limit(0), ["id"], "hyp", "ref", df["id"] > 0).count() == 0
