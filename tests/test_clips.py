"""Clips hold every word of their text, and what is scored on them takes every word into account."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clipflow.plans import QUERIES
from clipflow.plans.tables import clips

TEXTS = {1: " ".join(f"w{i % 61}" for i in range(300)), 2: "  short\ttext \n here ", 3: "a b c " * 14 + "Zoe met Adam", 4: ""}


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    p = tmp_path_factory.mktemp("long")
    pq.write_table(pa.table({"doc_id": pa.array(list(TEXTS), pa.int64()), "text": list(TEXTS.values()), "lang": ["en", "en", "de", "de"]}), f"{p}/documents.parquet")
    return str(p)


def left_out(i, words, k):
    return [w for j, w in enumerate(words) if (i + j) % k]


def test_clips_hold_all_words(spark, long_texts):
    for r in clips(spark, long_texts).collect():
        words = TEXTS[r.id].split()
        assert (r.reference.split(), r.hyp_a.split(), r.hyp_b.split()) == (words, left_out(r.id, words, 7), left_out(r.id, words, 11))


def test_scores_see_the_end_of_a_text(spark, long_texts):
    assert {r.id: r.nouns for r in QUERIES["proper_nouns"](spark, long_texts).collect()}[3] == "zoe adam"
    # repeated three-word runs: text 1 repeats itself only after its 40th word
    repeated = [len(g) > len(set(g)) for i, t in TEXTS.items() if i < 3 for w in [left_out(i, t.split(), 7)] for g in [list(zip(w, w[1:], w[2:]))]]
    assert {r.category: r.repeated_pct for r in QUERIES["degenerate_text"](spark, long_texts).collect()}["en"] == 100 * sum(repeated) / 2 == 50


def test_sentence_bleu_by_brute_force(spark, long_texts):
    import math

    got = {r.id: r.bleu for r in QUERIES["sentence_bleu"](spark, long_texts).collect()}
    ref = TEXTS[1].split()
    hyp, logs = left_out(1, ref, 7), []
    for n in range(1, 5):
        h, r = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
        logs.append(math.log(100 * sum((h & r).values()) / (len(hyp) - n + 1)))
    assert abs(got[1] - math.exp(1 - len(ref) / len(hyp)) * math.exp(sum(logs) / 4)) < 1e-3
