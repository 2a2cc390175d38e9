"""Hand-worked cases of the text functions and of BLEU and chrF."""

import math
import time

import pytest
from pyspark.sql import functions as F

from clipflow.functions import text as X
from clipflow.operators import textmetrics as M


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn("s").alias("x")).first().x


def test_numbers(spark):
    for text, want in {
        "It costs forty five dollars.": "it costs 45 dollars .", "June 10th": "june 10", "forty-five": "40 - 5", "$5": "5 dollars", "twenty third": "23", "20 5 5": "25 5", "thirty": "30", "": "", "10 th th x": "10 x", "twenty th 5": "20 5",
    }.items():
        assert one(spark, text, X.normalized_numbers) == want, text


def test_nouns(spark):
    assert one(spark, "Then I met Brian and NASA O'Neil. Hello there Brian", X.proper_nouns) == ["i", "brian", "hello"]


def test_similarity(spark):
    d = spark.createDataFrame([("blian", "brian"), ("columbs", "columbus"), ("osd", "osu"), ("", ""), ("a", "")], "a string, b string")
    assert [round(r.x, 3) for r in d.select(X.char_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.8, 0.875, 0.667, 1.0, 0.0]


def test_tokens(spark):
    assert one(spark, "It's 3.5, isn't it? (Yes) &amp; no-one 7-8.", X.tokens_13a) == ["It's", "3.5", ",", "isn't", "it", "?", "(", "Yes", ")", "&", "no-one", "7", "-", "8", "."]


def bleu(spark, pairs, effective=False):
    d = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id int, hyp string, ref string")
    return M.bleu_stats(d, ["id"], "hyp", "ref").agg(*(F.sum(n).alias(n) for n in M.BLEU)).select(M.bleu(effective=effective).alias("x")).first().x


def test_bleu(spark):
    same = "the cat sat on the mat"
    assert round(bleu(spark, [(same, same)]), 6) == 100
    assert bleu(spark, [("x y z w", same)]) == 0
    # 1-gram 2/4, 2-gram 1/3, then two orders without a match
    want = math.exp((math.log(50) + math.log(100 / 3) + math.log(100 / (2 * 2)) + math.log(100 / (4 * 1))) / 4)
    assert abs(bleu(spark, [("a b c d", "a b x y")]) - want) < 1e-9
    # brevity, and effective order for a text of two tokens
    assert abs(bleu(spark, [("a b", "a b c d")], True) - 100 * math.exp(1 - 2)) < 1e-9
    assert bleu(spark, [("", "a b c d")]) == 0


def test_chrf(spark):
    d = spark.createDataFrame([(1, "abc", "abd"), (2, "abc", "abc"), (3, "", "abc")], "id int, hyp string, ref string")
    got = {r.id: r.x for r in M.chrf_stats(d, ["id"], "hyp", "ref").select("id", M.chrf().alias("x")).collect()}
    p = (2 / 3 + 1 / 2 + 0) / 3
    assert abs(got[1] - 100 * p) < 1e-9 and abs(got[2] - 100) < 1e-9 and got[3] == 0


def test_exact_nouns_need_no_edit_distance(spark):
    """6,000 nouns that are all among 6,000 tokens: 36 million edit distances took more than 15 s."""
    words = [f"{'abcdefghij'[i % 10] * 6}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}noun" for i in range(6000)]
    d = spark.createDataFrame([(words, words[::-1]), (["berlin", "x", ""], ["merlin", "berlinale", "bern", "b"]), (["a"], [])], "nouns array<string>, tokens array<string>")
    start = time.monotonic()
    got = [r.best for r in d.select(M.best_similarity(F.col("nouns"), F.col("tokens")).alias("best")).collect()]
    assert time.monotonic() - start < 15
    assert got[0] == [1.0] * 6000 and got[1] == [pytest.approx(5 / 6), 0.0, 0.0] and got[2] == [0.0]
