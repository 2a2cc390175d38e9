"""Quality classifier: random Fourier features of document statistics, ridge scores from normal equations that the
partitions sum, isotonic calibration.

The statistics come from the text alone. Their mean and spread are taken over all documents, the normal equations over all
labelled documents whose remainder (crc32 of doc_id as text, modulo FOLDS) is 2 or more, the calibration over those of
remainder 1; remainder 0 is held out. Nothing sampled.

Null and empty texts have all-zero statistics and are scored like any other. Documents with several label rows count once
per row; null labels are left out. With no labels at all each score is 0.5. An empty table gives an empty result. Columns
beyond the ones named are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices, staged
from clipflow.llm.common import table as read
from clipflow.llm.textstats import STATS, doc_stats

FOLDS = 5
#: Random features, ridge strength and the bins that calibration merges.
N_FEATURES, RIDGE, BINS = 256, 1e-2, 2000


def features(rows: list[tuple[int, ...]]) -> np.ndarray:
    """Scale-free document statistics, one row each."""
    x = np.array(rows, float).reshape(len(rows), len(STATS))
    v = dict(zip(STATS, x.T, strict=True))
    words, chars, letters, lines = (np.maximum(v[k], 1) for k in ("n_words", "word_chars", "n_letters", "n_lines"))
    mean = v["word_chars"] / words
    return np.column_stack([
        np.log1p(v["n_words"]), mean, np.sqrt(np.maximum(v["len_sq"] / words - mean**2, 0)), np.log1p(v["longest_word"]),
        np.sqrt(v["n_symbols"] / words), np.sqrt(v["n_symbol_words"] / words), np.sqrt(v["n_dup_lines"] / lines),
        np.sqrt(v["n_repeat_words"] / words), v["n_distinct"] / words**0.8, np.sqrt(v["n_upper"] / letters), v["n_letters"] / chars,
        np.sqrt(v["n_digits"] / chars), np.sqrt(v["n_exclaim"] / words), np.sqrt(v["n_stops"] / words), v["n_short"] / words,
        np.log1p(v["n_words"] / lines),
    ])


N_STATS = features([(0,) * len(STATS)]).shape[1]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.weights + self.shift), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.edges, self.levels)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence, by pooling neighbours."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its features as an array."""

    def step(batch):
        x = features([doc_stats(t) for t in batch.column(text).to_pylist()])
        return {"doc_id": batch.column("doc_id"), "x": list(x)}

    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return map_slices(docs.select("doc_id", text), step, schema)


def fit(stats: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """stats: as ``statistics`` returns it, best staged. labels: doc_id and a column quality of 0 and 1."""
    row = stats.agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(N_STATS)])
    spread = np.array([row[f"s{i}"] or 1.0 for i in range(N_STATS)])
    rng = np.random.default_rng(seed)
    model = Model(mean, spread, rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES), np.zeros(N_FEATURES + 1), np.zeros(0), np.zeros(0))
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = stats.join(known, "doc_id").withColumn("fold", fold())
    size = N_FEATURES + 1

    upper = np.triu_indices(size, 0, size + 1)  # the products are symmetric; the last column is that of the labels
    places = upper[0] * (size + 1) + upper[1]

    def sums(batches):
        a, n = np.zeros((size, size + 1)), 0
        for b in batches:
            x = np.array(b.column("x").to_pylist()).reshape(b.num_rows, N_STATS)
            z = model.mapped(x)
            a += z.T @ np.column_stack([z, b.column("y").to_numpy(zero_copy_only=False)])
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(a[upper], n))], names=["place", "v"])

    # one row per matrix entry, so that no task ever holds the matrices of many partitions
    entries = rows.where("fold >= 2").mapInArrow(sums, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # (size + 1) * (size + 2) / 2 rows at most
    if not entries.num_rows:
        return model
    a = np.zeros(size * (size + 1))
    place, v = entries["place"].to_numpy(), entries["v"].to_numpy()
    n = float(v[place == -1][0])
    a[place[place >= 0]] = v[place >= 0]
    a = a.reshape(size, size + 1)
    a[:, :size] += np.triu(a[:, :size], 1).T
    ridge = np.linalg.solve(a[:, :size] + RIDGE * np.sqrt(n) * np.eye(size), a[:, size])
    model = Model(mean, spread, model.weights, model.shift, ridge, model.edges, model.levels)

    def scores(batch):
        return {"bin": np.clip(np.floor((model.raw(np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, N_STATS)) + 0.5) * BINS / 2), 0, BINS).astype(int), "y": batch.column("y")}

    bins = map_slices(rows.where("fold = 1"), scores, "bin int, y double", 4096).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()  # BINS + 1 rows at most
    if not bins:
        return Model(mean, spread, model.weights, model.shift, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at, count, ones = (np.array([float(b[k]) for b in bins]) for k in ("bin", "n", "y"))
    return Model(mean, spread, model.weights, model.shift, ridge, (at + 0.5) * 2 / BINS - 0.5, np.clip(isotonic(ones / count, count), 0, 1))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType(), False)])

    def step(batch):
        got = model.score(features([doc_stats(t) for t in batch.column(text).to_pylist()]))
        return {f.name: batch.column(f.name) for f in kept} | {"score": got}

    return map_slices(docs.select(*(f.name for f in kept)), step, schema)


def score_stats(stats: DataFrame, model: Model) -> DataFrame:
    def step(batch):
        return {"doc_id": batch.column("doc_id"), "score": model.score(np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, N_STATS))}

    return map_slices(stats, step, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType(), False)]), 4096)


def keep(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """The documents whose score is ``at`` or more, with their own columns, one named score among them."""
    model = fit(staged(statistics(docs), "stats"), labels)
    boxed = docs.select(F.struct("*").alias("row"), F.col("text").alias("__text"))
    return score(boxed, model, "__text").where(F.col("score") >= at).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    stats = staged(statistics(docs), "stats")
    return score_stats(stats, fit(stats, labels)).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
