"""Quality rules by weak supervision: rules vote good, bad or abstain; expectation-maximisation finds how far each is
to be trusted; a document is kept for its posterior probability instead of for passing every rule.

A document's votes form a pattern. There are at most 3 ** len(RULES) patterns however many documents there are, so Spark
counts patterns over all documents and the driver fits on those counts alone.

Null and empty texts have no words: every rule abstains but the length rule, and the base test fails them. Repeated rows
are judged alike, each on its own. Other columns are passed through; a column that has the name of an output is replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices, staged
from clipflow.llm.textstats import STATS, doc_stats

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes good at or below ``good``, bad above ``bad``, else abstains (``above``: the other way round)."""

    name: str
    value: str
    good: float
    bad: float
    above: bool = False

    def vote(self) -> Column:
        x = F.expr(self.value)
        good, bad = (x >= self.good, x < self.bad) if self.above else (x <= self.good, x > self.bad)
        return F.when(x.isNull(), 0).when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    Rule("length", "n_words", 40, 15, above=True),
    Rule("word_length", "abs(try_divide(word_chars, n_words) - 6)", 3.2, 6),
    Rule("symbols", "try_divide(n_symbols, n_words)", 0.05, 0.2),
    Rule("repeats", "try_divide(n_repeat_words, n_words)", 0.05, 0.2),
    Rule("lines", "try_divide(n_dup_lines, n_lines)", 0.1, 0.3),
    Rule("variety", "try_divide(n_distinct, pow(n_words, 0.8))", 0.7, 0.35, above=True),
    Rule("capitals", "try_divide(n_upper, n_letters)", 0.15, 0.5),
    Rule("exclamation", "try_divide(n_exclaim, n_words)", 0.1, 0.4),
    Rule("digits", "try_divide(n_digits, word_chars)", 0.15, 0.3),
    Rule("short_words", "try_divide(n_short, n_words)", 0.12, 0.05, above=True),
)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000, prior: float = 0.85, settled: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each vote pattern, and each rule's accuracy by class (bad, good).

    patterns: one row per pattern of -1, 0, 1. Starts from rules that are right more often than not, and smooths by a few
    invented votes, so that the two classes keep their meaning. Ends when no posterior moves by more than ``settled``; warns if
    that takes more than ``rounds``.
    """
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    right = np.array([np.full(patterns.shape[1], 0.3), np.full(patterns.shape[1], 0.98)])  # P(right vote | class, votes)
    share = prior
    weight = counts.astype(float)
    post = np.full(len(weight), share)
    for _ in range(rounds):
        log_good = np.log(share) + good @ np.log(right[1]) + bad @ np.log1p(-right[1])
        log_bad = np.log1p(-share) + bad @ np.log(right[0]) + good @ np.log1p(-right[0])
        before, post = post, 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        if np.abs(post - before).max(initial=0) <= settled:
            break
        w_good, w_bad = weight * post, weight * (1 - post)
        right = np.array([(3 + w_bad @ bad) / (10 + w_bad @ (good + bad)), (98 + w_good @ good) / (100 + w_good @ (good + bad))])
        share = float(np.clip((w_good.sum() + 8.5) / (weight.sum() + 10), 0.02, 0.98))
    else:
        warnings.warn(f"the votes have not settled in {rounds} rounds", stacklevel=2)
    return post, right


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, and the counts named in STATS."""
    passed = [f for f in docs.schema.fields if f.name != text and f.name not in STATS]
    schema = T.StructType([*passed, *(T.StructField(s, T.LongType(), False) for s in STATS)])

    def step(batch):
        values = list(zip(*map(doc_stats, batch.column(text).to_pylist()), strict=True))
        return {f.name: batch.column(f.name) for f in passed} | dict(zip(STATS, values, strict=True))

    return map_slices(docs.select(text, *(f.name for f in passed)), step, schema)


def judge(docs: DataFrame, text: str = "text", keep_at: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: the counts, each rule's vote, ``base_failed``, ``p_good`` and ``kept``."""
    made = {*STATS, *(f"vote_{r.name}" for r in rules), "p_good", "base_failed", "kept"}
    stats = staged(with_stats(docs.drop(*(c for c in docs.columns if c in made and c != text)), text), "rules")
    voted = stats.withColumns({f"vote_{r.name}": r.vote() for r in rules})
    votes = [f"vote_{r.name}" for r in rules]
    found = voted.groupBy(*votes).count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([[r[v] for v in votes] for r in found], int).reshape(len(found), len(votes))
    post, _ = fit_votes(patterns, np.array([r["count"] for r in found]))
    spark = docs.sparkSession
    schema = T.StructType([*(T.StructField(v, T.IntegerType()) for v in votes), T.StructField("p_good", T.DoubleType())])
    table = spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(patterns, post, strict=True)], schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.join(F.broadcast(table), votes, "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))
    )


def query(spark, sf_dir: str) -> DataFrame:
    from clipflow.llm.common import table as read

    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "p_good")
