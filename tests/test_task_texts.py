"""Text functions that run in tasks give what the column expressions give, on awkward texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clipflow.functions import ngrams as N
from clipflow.functions import text as X

PIECES = ["a", "B", "é", "İ", "ß", "Σ", "中", "𝒳", " ", "  ", "\n", "-\n", "\t", "\x0b", "\x1c", "\xa0", " ", ".", ",", "..", ".,", "-", "1", "20", "5", "020", "7", "th", "st", "'", "$", "$ 5", "twenty", "one", "Fourth", "thirty five", "&quot;", "&amp;", "<skipped>", "/", "~", "{", "[", "`", "_", "\\", "!", "@", "٣", "99999999999999999999"]


def texts(n=1500):
    draw = random.Random(3)
    return ["".join(draw.choice(PIECES) + draw.choice(["", " "]) for _ in range(draw.randrange(25))) for _ in range(n)]


def test_words_and_numbers(spark):
    d = spark.createDataFrame([(t,) for t in texts()], "t string")
    rows = d.select("t", X.tokens_13a("t").alias("words"), X.lowered("t").alias("low"), X.normalized_numbers("t").alias("numbers"), F.regexp_replace("t", r"\s+", "").alias("bare")).collect()
    assert [X.words_13a(r.t) for r in rows] == [r.words for r in rows]
    assert [X.numbers_as_digits(r.low) for r in rows] == [r.numbers for r in rows]
    some = [rows[i : i + 40] for i in range(0, 1500, 40)]
    for part in some:
        got = N.overlaps(*N.bare_codes([[r.t for r in part], [r.numbers for r in part]]), 6)
        bare = ["".join(c for c in r.numbers if c not in " \t\n\x0b\x0c\r") for r in part]
        assert np.array_equal(got, N.overlap_columns(pa.array([r.bare for r in part]), pa.array(bare), 6))


def test_grams_by_table_and_by_hash(monkeypatch):
    sides = [[t.split(" ") for t in texts(60)], [t.split(" ") for t in texts(120)[60:]]]
    by_table = N.overlaps(*N.word_codes(sides), 4)
    monkeypatch.setattr(N, "TABLE", 0)
    assert np.array_equal(by_table, N.overlaps(*N.word_codes(sides), 4))


def same_tokens(found, sides):
    codes, tokens, sizes = found
    each = np.concatenate(sizes)
    got = [[tokens[c] for c in codes[e - n : e]] for e, n in zip(np.cumsum(each), each, strict=True)]
    assert got == [words for side in sides for words in side]


def test_words_are_cut_once_and_joined_as_in_whole_texts():
    """Tokens of distinct words, put together, are those of the whole texts; numbers act on their neighbours, not on those of the next text."""
    ends = ["twenty", "5 th st rd x", "", "th 20", "5", "20 5 30 6 th", "nd", "٣ ² 0020 005", " \x0b\x1c20\x1c5"]
    for some in (texts(800), ends, ["", ""], [t + "\n" for t in texts(60)] + ["a-<skipped>\nb &amp;quot; -", "..,.-1,2.3-- .", "1-\n2 . .5"]):
        half = len(some) // 2
        sides, arrays = [some[:half], some[half:]], [pa.array(some[:half], pa.string()), pa.array(some[half:], pa.string())]
        same_tokens(N.cut_words([X.replaced(a) for a in arrays], X.tokens_of_word), [[X.words_13a(t) for t in side] for side in sides])
        low = [[t.lower() for t in side] for side in sides]
        found = X.numbers_joined(*N.cut_words([pa.array(side, pa.string()) for side in low], X.number_tokens))
        plain = [[X.numbers_as_digits(t) for t in side] for side in low]
        same_tokens(found, [[X.words_13a(t) for t in side] for side in plain])
        if 2 * half == len(some):
            assert np.array_equal(N.overlaps(*N.bare_codes(plain), 6), N.sorted_overlaps(*N.point_codes(*found), 6))
    seen = []
    N.cut_words([pa.array(["a b a", None]), pa.array(["b  a", "a c"])], lambda w: seen.append(w) or (w,))
    assert sorted(seen) == ["", "a", "b", "c"] or sorted(seen) == ["a", "b", "c"]  # each occurrence was cut before


def test_ends_of_words():
    for word in [a + b + c for a in ("", "ab", "7", "a7", "é", "²", "a-", "1.5", "x'") for b in ("", *".,;:!?)-'\"(%") for c in ("", *".,;:!?)-'")]:
        assert X.tokens_of_word(word) == tuple(X.words_13a(word)), word
        assert X.number_tokens(word) == X.number_parts(word), word


def test_grams_by_one_sort():
    some = [[t.split(" ") for t in texts(90)], [t.split(" ") for t in texts(180)[90:]]]
    for sides in (some, [[["a"], [], ["a", "b", "a"]], [[], ["b"], ["a", "b", "c", "a", "b"]]], [[[]], [[]]]):
        codes, bound, sizes = N.word_codes(sides)
        want = N.overlaps(codes, bound, sizes, 4)
        assert np.array_equal(want, N.sorted_overlaps(codes, bound, sizes, 4))
        assert np.array_equal(want, N.sorted_overlaps(codes * 2**20, bound * 2**20, sizes, 4))  # too large for one number
