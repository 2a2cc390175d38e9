"""URL filters: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over the bytes of a URL are counted, one over every URL that a rule allows, one over every
URL that a rule blocks (a fifth, chosen by hash, is kept apart). A byte's probability after up to ORDER bytes is interpolated with
that after one byte less (Witten-Bell), down to a uniform one. A URL's score is the difference of the two log-likelihoods per byte; the
threshold is the one with the best balanced accuracy on the URLs kept apart, from a histogram of their scores.

The counts are exact sums over all such URLs in long integers, held as a distributed table with a row for each gram and each context.
URLs are scored in blocks of BLOCK: the distinct codes of a block are joined to that table, and the block is scored with what it met.
Nothing that grows with the corpus comes to the driver or is broadcast. Left to itself Spark broadcasts the codes: it takes them for smaller
than the URLs that they are made of, and they are some twenty times as large. So the join is told to merge.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and are scored as they are (null as empty). Without
URLs of both kinds the models have no say and the verdict is allow. Repeated rows stay rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices, staged, to_arrow
from clipflow.llm.common import table as read

#: Host and path prefix, and what becomes of URLs that they fit.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
ORDER, BLOCK_BITS, BINS, APART = 5, 9, 16000, 5
BLOCK = 1 << BLOCK_BITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Set in the code of a context, so that grams and contexts share one table.
CONTEXT = 1 << 62


def ruled(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and ruling (null where no rule fits)."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    df = pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})
    rule = ruling = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + rest))
        rule, ruling = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return df.withColumns({"rule": rule, "ruling": ruling})


def codes(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the URL and, for each of its bytes and each order from 0 to ORDER, the code of context and byte (0: none).

    A code is the order plus one in the top byte over the bytes themselves, so it is exact. Each URL is led by byte 2 and
    ended by byte 3.
    """
    raws = [b"\2" + (u or "").encode() + b"\3" for u in urls]
    sizes = np.array([len(r) for r in raws])
    every = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value, out = every.copy(), []
    for k in range(ORDER + 1):
        if k:
            value = value.copy()
            value[k:] |= every[:-k] << np.uint64(8 * k)
        out.append(np.where(place >= k, value | np.uint64((k + 1) << 56), 0))
    seen = place > 0  # the leading byte is only context
    return np.repeat(np.arange(len(raws)), sizes)[seen], np.stack(out, 1)[seen]


def context(code: np.ndarray) -> np.ndarray:
    top = code & np.uint64(0xFF << 56)
    return top | ((code ^ top) >> np.uint64(8)) | np.uint64(CONTEXT)


def score(urls: list[str | None], table: pa.Table) -> np.ndarray:
    """Log-likelihood difference per byte; above 0 a URL is more like the allowed ones. table: the rows of ``tabled`` that the URLs meet."""
    of, code = codes(urls)
    order = np.argsort(table.column("code").to_numpy(), kind="stable")
    keys = table.column("code").to_numpy()[order]
    n, kinds = ([np.append(table.column(f"{v}{c}").to_numpy()[order], 0) for c in (0, 1)] for v in ("n", "k"))  # the last row: not there

    def at(wanted: np.ndarray) -> np.ndarray:
        wanted = wanted.view(np.int64)
        found = np.searchsorted(keys, wanted)
        there = np.append(keys, 0)[found] == wanted
        return np.where(there, found, len(keys))

    p = [np.full(len(of), 1 / 256) for _ in (0, 1)]
    for k in range(ORDER + 1):
        gram, before, there = at(code[:, k]), at(context(code[:, k])), code[:, k] > 0
        for c in (0, 1):
            total, followers = n[c][before], kinds[c][before]
            better = (n[c][gram] + followers * p[c]) / np.maximum(total + followers, 1)
            p[c] = np.where(there & (total > 0), better, p[c])
    log = np.log(p[1]) - np.log(p[0])
    return np.bincount(of, log, len(urls)) / np.maximum(np.bincount(of, minlength=len(urls)), 1)


def tabled(grams: DataFrame) -> DataFrame:
    """grams: c, code, n. Returns a row for each gram and each context: code, n0 and n1 (counts by class), k0 and k1 (a context's followers)."""
    top = F.col("code").bitwiseAND(F.lit(-(1 << 56)))
    ctx = top.bitwiseOR(F.shiftright(F.col("code").bitwiseXOR(top), 8)).bitwiseOR(F.lit(CONTEXT))
    sums = [F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    own = grams.groupBy("code").agg(*sums, *(F.lit(0).cast("long").alias(f"k{c}") for c in (0, 1)))
    return own.union(grams.groupBy(ctx.alias("code")).agg(*sums, *(F.count_if(F.col("c") == c).alias(f"k{c}") for c in (0, 1))))


def scored(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which has a column u (the URL), with its score."""
    placed = staged(df.withColumn("__block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "urls")

    def codes_of(batch):
        block = batch.column("__block").to_numpy()
        of, code = codes(batch.column("u").to_pylist())
        out = {"__block": [], "code": []}
        for b in np.unique(block):
            mine = code[block[of] == b].ravel()
            mine = np.unique(mine[mine > 0])
            got = np.concatenate([mine, np.unique(context(mine))])
            out["__block"].append(np.full(len(got), b))
            out["code"].append(got.view(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()}

    met = map_slices(placed.select("__block", "u"), codes_of, "__block long, code long", BLOCK).join(table.hint("merge"), "code")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    arrow = to_arrow(schema)

    def step(urls: pa.Table, part: pa.Table) -> pa.Table:
        columns = [urls.column(f.name).cast(f.type) for f in arrow if f.name != "score"]
        return pa.Table.from_arrays([*columns, pa.array(score(urls.column("u").to_pylist(), part))], schema=arrow)

    return placed.groupBy("__block").cogroup(met.groupBy("__block")).applyInArrow(step, schema)


@dataclass(frozen=True)
class Ratio:
    """table: as ``tabled`` returns it, staged."""

    table: DataFrame
    threshold: float = 0.0

    def score(self, urls: list[str | None]) -> list[float]:
        df = self.table.sparkSession.createDataFrame(list(enumerate(urls)), "place long, u string")
        return [r.score for r in sorted(scored(df, self.table).select("place", "score").collect())]


def fit(judged: DataFrame, url: str = "url") -> Ratio | None:
    """judged: as ``ruled`` returns it."""
    known = judged.where("ruling is not null").select(F.col(url).alias("u"), F.when(F.col("ruling") == "allow", 1).otherwise(0).alias("c"), (F.pmod(F.xxhash64(url), F.lit(APART)) == 0).alias("apart"))

    def count(batch):
        of, code = codes(batch.column("u").to_pylist())
        c = np.repeat(np.array(batch.column("c").to_pylist(), np.int64)[of], ORDER + 1)
        flat = code.ravel()
        out = {"c": [], "code": [], "n": []}
        for k in (0, 1):
            got, n = np.unique(flat[(c == k) & (flat > 0)], return_counts=True)
            out["c"].append(np.full(len(got), k))
            out["code"].append(got.view(np.int64))
            out["n"].append(n)
        return {k: np.concatenate(v) for k, v in out.items()}

    grams = staged(map_slices(known.where("not apart"), count, "c int, code long, n long", 4096).groupBy("c", "code").agg(F.sum("n").alias("n")), "grams")
    if {r.c for r in grams.select("c").distinct().collect()} != {0, 1}:
        return None
    table = staged(tabled(grams), "url-model")
    bins = F.least(F.floor((F.atan("score") / math.pi + 0.5) * BINS), F.lit(BINS - 1)).cast("int")  # the whole line, finest around 0
    held = scored(known.where("apart").select("u", "c"), table).groupBy(bins.alias("bin"), "c").count().collect()  # 2 * BINS rows at most
    counts = np.zeros((2, BINS))
    for r in held:
        counts[r.c, r.bin] += r["count"]
    if not counts.sum(1).all():
        return Ratio(table)
    blocked, allowed = np.cumsum(counts[0]) / counts[0].sum(), 1 - np.cumsum(counts[1]) / counts[1].sum()
    gain = np.concatenate([[1.0], blocked + allowed])  # for thresholds below the first bin, then above each
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return Ratio(table, math.tan((best[len(best) // 2] / BINS - 0.5) * math.pi))


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where the models have no say)."""
    judged = ruled(pages.select("page_id", url), url, rules)
    model = fit(judged, url)
    names = ("page_id", "host", "path", "rule", "ruling")
    if model is None:
        return judged.select(*names, F.lit(None).cast("double").alias("score")).withColumn("verdict", F.coalesce("ruling", F.lit("allow"))).drop("ruling")
    out = scored(judged.select(*names, F.col(url).alias("u")), model.table).drop("u")
    by_model = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce("ruling", by_model)).drop("ruling")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
