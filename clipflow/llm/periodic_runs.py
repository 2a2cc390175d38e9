"""Periodic runs of words by an online sparse diagonal program.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of LEAST words and of three periods at
least, that no neighbouring word extends. Word i and its earlier occurrence j lie on the diagonal of lag i - j. Words are read in
order; each adds one to the match length of the diagonals that its earlier occurrences lie on, and a diagonal that a word does
not continue ends: if it is long enough, its run is given at once. Only diagonals that the last word was on are held.

Which earlier occurrences count keeps that sparse, and loses no run:

* A run of lag q holds at least max(LEAST - q, 2 q) matches in a row, so an occurrence counts only if the words after it go on
  matching for as long as that: lags are taken in classes, 1 to 15 with 16 words of context, then q from G / 2 to G - 1 with G.
  Equal contexts have equal numbers, made by doubling; a text without an equal pair of 16 words is done after one sort.
* If a context of G words occurs at distance p <= G / 2 before, all its occurrences nearer than G belong to the same stretch of
  period p, their lags are multiples of p, and their diagonals end where that of p does. So only p counts then.
* Else occurrences are followed back as far as G words. Words of which that is more than one lie in the first period of
  a stretch of smaller period, so the steps, too, are of the order of the words in each class.

Time is then of order n log^2 n, and memory of order n, for texts of any kind, one word a million times over included.

Null and empty texts have no runs and collapse to an empty text. Repeated rows are treated alike, each on its own. Other columns
are passed through; columns named runs or collapsed, or like the text, are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices
from clipflow.llm.common import table as read

LEAST, PERIODS, CONTEXT = 24, 3, 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def numbers(words: list[bytes]) -> np.ndarray:
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def repeats_context(ids: np.ndarray) -> bool:
    """Whether some CONTEXT words may occur twice; by hash, so it may say yes for none, but not no."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    h ^= h >> np.uint64(29)
    factor, k = MIX | np.uint64(1), 1
    while k < CONTEXT:
        h = h[:-k] * factor + h[k:]
        factor, k = factor * factor, 2 * k
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def doubled(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the contexts of 2 * k words from those of k words."""
    _, rank = np.unique(codes[:-k] * (int(codes.max()) + 1) + codes[k:], return_inverse=True)
    return rank.reshape(-1)


def last_before(codes: np.ndarray) -> np.ndarray:
    """Where the same context occurred last; -1 if it did not."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    out = np.full(len(codes), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def occurrences(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Words and the lags of those earlier occurrences that count, for each context length."""
    out, codes, k = [], ids, 1
    with np.errstate(over="ignore"):
        if len(ids) < LEAST or not repeats_context(ids):
            return out
    while 2 * k <= len(ids):
        codes, k = doubled(codes, k), 2 * k
        if k < CONTEXT:
            continue
        before = last_before(codes)
        at = np.flatnonzero(before >= 0)
        if not len(at):
            break
        earlier, least = before[at], 1 if k == CONTEXT else k // 2
        near = at - earlier >= least
        at, earlier = at[near], earlier[near]
        while len(at):
            lag = at - earlier
            within = lag < k
            at, earlier, lag = at[within], earlier[within], lag[within]
            out.append((at, lag, k))
            further = (lag > k // 2) & (before[earlier] >= 0)
            at, earlier = at[further], before[earlier[further]]
    return out


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = occurrences(numbers(words))
    if not found:
        return []
    at, lag = np.concatenate([a for a, _, _ in found]), np.concatenate([q for _, q, _ in found])
    context = np.concatenate([np.full(len(a), k) for a, _, k in found])
    order = np.argsort(at, kind="stable")
    out: dict[tuple[int, int], int] = {}

    def ended(q: int, matches: int, k: int, last: int):
        """A diagonal of ``matches`` words, the last of them at ``last``, each followed by ``k`` - 1 more matches."""
        length = matches + k - 1 + q
        if length >= max(LEAST, PERIODS * q):
            stretch = last + k - length, length
            out[stretch] = min(q, out.get(stretch, q))

    active: dict[int, tuple[int, int]] = {}
    going: dict[int, tuple[int, int]] = {}
    word = -1
    for i, q, k in zip(at[order].tolist(), lag[order].tolist(), context[order].tolist(), strict=True):
        if i != word:
            for lag_, (m, k_) in active.items():
                ended(lag_, m, k_, word - 1)
            active, going = going, {}
            if i != word + 1:
                for lag_, (m, k_) in active.items():
                    ended(lag_, m, k_, word)
                active = {}
            word = i
        going[q] = active.pop(q, (0, k))[0] + 1, k
    for held, last in ((active, word - 1), (going, word)):
        for lag_, (m, k_) in held.items():
            ended(lag_, m, k_, last)
    return sorted((s, n, q) for (s, n), q in out.items())


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed``, the text without repetition, in place of the text."""
    passed = [f for f in docs.schema.fields if f.name not in (text, "runs", "collapsed")]
    schema = T.StructType([*passed, T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType(), False)])

    def step(batch):
        found, texts = [], []
        for value in batch.column(text).to_pylist():
            words = (value or "").encode().split()  # at bytes 9 to 13 and 32, as [^\x20\x09-\x0D]+ does
            own = runs(words)
            found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            texts.append(b" ".join(kept(words, own) if own else words).decode())
        return {f.name: batch.column(f.name) for f in passed} | {"runs": found, "collapsed": texts}

    return map_slices(docs.select(text, *(f.name for f in passed)), step, schema)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a periodic end in about one text of ten, as the key's checksum says; null keys and other texts as they are."""

    def rewritten(key, value):
        h = zlib.crc32(str(key).encode())
        words = (value or "").encode().split()
        if key is None or h % 10 or not words:
            return value
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)]).decode()

    def step(batch):
        pairs = zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True)
        return {n: batch.column(n) for n in batch.schema.names if n != text} | {text: [rewritten(k, v) for k, v in pairs]}

    return map_slices(docs, step, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = collapse(planted(read(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = out.withColumn("best", F.aggregate("runs", F.try_element_at("runs", F.lit(1)), longer))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
