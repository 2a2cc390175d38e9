"""The URL models count every gram apart, in exact numbers: scores equal those of plain dictionaries."""

import math
from collections import Counter

import pyarrow.parquet as pq

from clipflow.llm import url_filters as U
from clipflow.llm.queries import QUERIES


def test_op8_scores_by_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    from pyspark.sql import functions as F

    known = U.ruled(pages).where("ruling IS NOT NULL").where(F.pmod(F.xxhash64("url"), F.lit(U.APART)) != 0).select("url", "ruling").collect()
    n, total, kinds = (Counter() for _ in range(3))
    for url, ruling in known:
        raw = b"\2" + url.encode() + b"\3"
        for i in range(1, len(raw)):
            for k in range(min(i, U.ORDER) + 1):
                key = ruling, raw[i - k : i]
                kinds[key] += not n[*key, raw[i]]
                n[*key, raw[i]] += 1
                total[key] += 1
    got = {r.page_id: r.score for r in QUERIES["op8_url_filters"](spark, sf).collect()}
    for page in pq.read_table(f"{sf}/pages.parquet", columns=["page_id", "url"]).to_pylist():
        raw, log = b"\2" + page["url"].encode() + b"\3", 0.0
        for i in range(1, len(raw)):
            for ruling, sign in (("allow", 1), ("block", -1)):
                p = 1 / 256
                for k in range(min(i, U.ORDER) + 1):
                    key = ruling, raw[i - k : i]
                    if total[key]:
                        p = min(1, (n[*key, raw[i]] + kinds[key] * p) / (total[key] + kinds[key]))
                log += sign * math.log(p)
        assert abs(got[page["page_id"]] - log / (len(raw) - 1)) < 1e-9, page


def test_op8_counts_above_float32(spark):
    grams = spark.createDataFrame([(0, 1 << 56 | 65, 2**24 + 1), (1, 1 << 56 | 65, 3)], "c int, code long, n long")
    assert {(r.n0, r.n1, r.k0, r.k1) for r in U.tabled(grams).collect()} == {(2**24 + 1, 3, 0, 0), (2**24 + 1, 3, 1, 1)}


def test_op8_codes_of_urls_are_not_broadcast(spark, sf, capsys):
    """Neither side of the join by code is broadcast, however small Spark takes it for: both grow with the corpus."""
    judged = U.ruled(spark.read.parquet(f"{sf}/pages.parquet"))
    U.scored(judged.selectExpr("page_id", "url AS u"), U.fit(judged).table).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
