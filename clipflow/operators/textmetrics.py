"""Corpus text metrics from additive statistics: each clip gives a fixed vector, and every score of any set of clips is a closed
form of the vectors' sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.functions.ngrams import bare_codes, cut_words, parts, point_codes, sorted_overlaps
from clipflow.functions.text import char_similarity, lowered, number_tokens, numbers_joined, replaced, tokens_of_word

ORDERS, CHARS, BETA = 4, 6, 2.0
BLEU = [f"{k}{n}" for k in ("m", "t") for n in range(1, ORDERS + 1)] + ["hyp_len", "ref_len"]
CHRF = [f"{k}{n}" for k in ("cm", "ch", "cr") for n in range(1, CHARS + 1)]


def grams(values: Column, n: int, text: bool = False) -> Column:
    """The runs of ``n`` tokens, or of ``n`` characters of a text, in order."""

    def cut(v: Column) -> Column:
        size = F.length(v) if text else F.size(v)
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(v, i, F.lit(n)) if text else F.array_join(F.slice(v, i, n), " "))

    return F.transform(F.array(values), cut)[0]  # bound to a variable, so that the values are made once and not for each gram


def counted(df: DataFrame, keys: list[str], hyp: str, ref: str, words: bool = True, chars: Column | None = None, numbers: Column | None = None) -> DataFrame:
    """Per row the overlaps of tokens (``words``) and, where ``chars`` holds, of characters (else zeros). A null text is an empty one.

    Where ``numbers`` holds, numbers are normalised first. Texts travel as they are and become tokens in the row's task: token arrays and
    exploded grams are many times as large. Rows are counted together in parts of bounded bytes.
    """
    orders = {k: n for used, of, n in ((words, ("m", "t", "u"), ORDERS), (chars is not None, ("cm", "ch", "cr"), CHARS)) if used for k in of}
    columns = [f"{k}{n}" for k, most in orders.items() for n in range(1, most + 1)]
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, T.LongType(), False) for c in columns)])
    flags = {"__chars": chars, "__numbers": numbers}
    given = [c.alias(n) for n, c in flags.items() if c is not None]
    # lower case by Spark, as everywhere else: alphabets differ by Unicode version
    text = lambda c: F.col(c) if numbers is None else F.when(numbers, lowered(c)).otherwise(F.col(c))

    scored, normalised = chars is not None, numbers is not None

    def count(part: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((part.num_rows, len(columns)), np.int64)
        flag = lambda name, used: part.column(name).fill_null(False).to_numpy(zero_copy_only=False) if used else np.zeros(part.num_rows, bool)
        digits, wanted = flag("__numbers", normalised), flag("__chars", scored)
        for rows in (np.flatnonzero(~digits), np.flatnonzero(digits)):
            if not len(rows):
                continue
            sides = [part.column(side).take(pa.array(rows)) for side in ("__hyp", "__ref")]
            found = None
            if digits[rows[0]]:  # such tokens are their own 13a tokens
                found = numbers_joined(*cut_words(sides, number_tokens))
            elif words:
                found = cut_words([replaced(side) for side in sides], tokens_of_word)
            if words:
                out[rows, : 3 * ORDERS] = sorted_overlaps(found[0], len(found[1]) + 1, found[2], ORDERS)
            if wanted[rows].any():
                coded = point_codes(*found) if digits[rows[0]] else bare_codes([[t or "" for t in side.to_pylist()] for side in sides])
                out[rows, -3 * CHARS :] = sorted_overlaps(*coded, CHARS) * wanted[rows][:, None]
        return out.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in count(part))], names=[*keys, *columns])

    return df.select(*keys, text(hyp).alias("__hyp"), text(ref).alias("__ref"), *given).mapInArrow(run, schema)


def all_stats(df: DataFrame, keys: list[str], hyp: str, ref: str, chars: Column, numbers: Column | None = None) -> DataFrame:
    """The columns of BLEU and, for the rows where ``chars`` holds, of CHRF (else zeros), from one pass; where ``numbers`` holds, with numbers normalised."""
    found = counted(df, keys, hyp, ref, chars=chars, numbers=numbers)
    return found.withColumns({"hyp_len": F.col("t1"), "ref_len": F.col("u1")}).select(*keys, *BLEU, *CHRF)


def bleu_stats(df: DataFrame, keys: list[str], hyp: str, ref: str) -> DataFrame:
    """The columns of BLEU, one row for each row of ``df``."""
    return counted(df, keys, hyp, ref).withColumns({"hyp_len": F.col("t1"), "ref_len": F.col("u1")}).select(*keys, *BLEU)


def chrf_stats(df: DataFrame, keys: list[str], hyp: str, ref: str) -> DataFrame:
    """The columns of CHRF, one row for each row of ``df``."""
    return counted(df, keys, hyp, ref, words=False, chars=F.lit(True))


def bleu(get=F.col, effective: bool = False) -> Column:
    """BLEU of summed statistics, exponential smoothing; ``effective``: only the orders that the text is long enough for."""
    m, t = ([get(f"{k}{n}") for n in range(1, ORDERS + 1)] for k in ("m", "t"))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    zero = [F.when((m[n] == 0) & (t[n] > 0), 1).otherwise(0) for n in range(ORDERS)]
    logs = [F.when(t[n] > 0, F.ln(F.when(m[n] > 0, 100.0 * m[n] / t[n]).otherwise(100.0 / (F.pow(F.lit(2.0), add(zero[: n + 1])) * t[n])))).otherwise(0.0) for n in range(ORDERS)]
    orders = add([F.when(x > 0, 1).otherwise(0) for x in t])
    usable = (t[0] > 0) if effective else (t[-1] > 0)
    bp = F.when(get("hyp_len") >= get("ref_len"), 1.0).otherwise(F.exp(1 - F.try_divide(get("ref_len"), get("hyp_len"))))
    return F.when((add(m) == 0) | ~usable, 0.0).otherwise(bp * F.exp(add(logs) / orders))


def chrf(get=F.col) -> Column:
    """chrF2 of summed statistics: precision and recall averaged over the orders that both sides have."""
    m, h, r = ([get(f"{k}{n}") for n in range(1, CHARS + 1)] for k in ("cm", "ch", "cr"))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    both = [(h[n] > 0) & (r[n] > 0) for n in range(CHARS)]
    orders = add([F.when(b, 1).otherwise(0) for b in both])
    p = F.try_divide(add([F.when(both[n], m[n] / h[n]).otherwise(0.0) for n in range(CHARS)]), orders)
    q = F.try_divide(add([F.when(both[n], m[n] / r[n]).otherwise(0.0) for n in range(CHARS)]), orders)
    return F.coalesce(100.0 * F.try_divide((1 + BETA**2) * p * q, BETA**2 * p + q), F.lit(0.0))


def best_similarity(nouns: Column, tokens: Column) -> Column:
    """For each noun the highest similarity to a token; 0 without tokens.

    A noun that is a token has 1 without any edit distance; for others a token whose length alone keeps it from being better is passed over.
    """

    def most(t: Column, w: Column) -> Column:
        bound = lambda g: 1.0 - F.abs(F.length(w) - F.length(g)) / F.greatest(F.length(w), F.length(g))
        return F.aggregate(t, F.lit(0.0), lambda x, g: F.when(bound(g) <= x, x).otherwise(F.greatest(x, char_similarity(w, g))))

    best = lambda t: F.transform(nouns, lambda w: F.when(F.array_contains(t, w), 1.0).otherwise(most(t, w)))
    return F.transform(F.array(F.array_distinct(tokens)), best)[0]  # bound to a variable, as above; a repeat can't be better
