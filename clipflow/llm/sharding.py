"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows of equal text are a group. The group, or bundle of groups, that needs the largest share of any capacity goes first, and
each goes to the shard where the dot product of its demand with the residual capacity is highest, among the shards where it
fits (if it fits nowhere: among all, by the least overflow).

A group stays whole unless it exceeds a shard's capacity in bytes, tokens or rows; such a group is dealt in PIECES parts by a
hash of the row (rows repeated under one doc_id are dealt too). At most 3 * shards groups can exceed it. Groups smaller than 1 / BUNDLES of the total in all three are bundled
by a hash of their text, BUNDLES bundles in all, so the packing itself works on a number of rows that is bounded whatever the
table holds: BUNDLES bundles, 3 * BUNDLES larger groups, 3 * shards * PIECES parts.

Null text: size 1, no tokens, checksum 0, a group of its own. Repeated rows each get a slot. Null doc_ids come first in their
block. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import staged
from clipflow.llm.common import table as read

BUNDLES, PIECES = 2048, 64
#: Rows that one window of the slot numbering is meant to hold.
BLOCK_ROWS = 50_000


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, tokens (runs of characters between blanks), text_crc32, the group key and a number that deals even equal rows apart."""
    t = F.coalesce(text, F.lit(""))
    raw = t.cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")).alias("key"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("dealt"),
    )


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``demand`` (bytes, tokens, rows), largest share of the total first."""
    total = np.maximum(demand.sum(0), 1)
    need = demand / total
    left = np.full((shards, demand.shape[1]), 1 / shards)
    out = np.zeros(len(demand), int)
    for i in np.lexsort((np.arange(len(need)), -need.max(1))):
        value = left @ need[i]
        fits = (left >= need[i]).all(1)
        value = np.where(fits, value, -np.inf) if fits.any() else -np.maximum(need[i] - left, 0).max(1)
        out[i] = int(value.argmax())
        left[out[i]] -= need[i]
    return out


def assign(docs: DataFrame, shards: int, text: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, tokens, key and shard."""
    rows = staged(measured(docs, text).withColumn("piece", F.pmod("dealt", F.lit(PIECES))), "sizes")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")]
    pieces = staged(rows.groupBy("key", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "pieces")
    groups = staged(pieces.groupBy("key").agg(*sums), "groups")
    all_ = groups.agg(*sums).first()
    if not all_["n"]:
        return rows.withColumn("shard", F.lit(0))
    share = F.greatest(*(F.col(c) / F.lit(max(all_[c], 1)) for c in ("size", "tokens", "n")))
    kind = F.when(share > 1 / shards, 2).when(share > 1 / bundles, 1).otherwise(0)
    sorted_ = groups.select("*", kind.alias("kind"))
    small = sorted_.where("kind = 0").withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(bundles)))
    items = [(r, 0) for r in small.groupBy("bundle").agg(*sums).orderBy("bundle").collect()]
    items += [(r, 1) for r in sorted_.where("kind = 1").orderBy("key").collect()]
    large = sorted_.where("kind = 2").select("key")
    parts = pieces.join(F.broadcast(large), "key", "left_semi")  # 3 * shards keys at most
    items += [(r, 2) for r in parts.orderBy("key", "piece").collect()]
    placed = pack(np.array([[r["size"], r["tokens"], r["n"]] for r, _ in items], float), shards)
    rows_of = lambda k, *cols: [(*(r[c] for c in cols), int(s)) for (r, kind), s in zip(items, placed, strict=True) if kind == k]
    spark = docs.sparkSession
    by_bundle = spark.createDataFrame(rows_of(0, "bundle"), "bundle long, s0 int")
    by_key = spark.createDataFrame(rows_of(1, "key"), "key string, s1 int")
    by_piece = spark.createDataFrame(rows_of(2, "key", "piece"), "key string, piece long, s2 int")
    out = rows.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(bundles)))
    out = out.join(F.broadcast(by_piece), ["key", "piece"], "left").join(F.broadcast(by_key), "key", "left").join(F.broadcast(by_bundle), "bundle", "left")
    return out.withColumn("shard", F.coalesce("s2", "s1", "s0")).drop("s0", "s1", "s2", "bundle", "piece")


def slotted(placed: DataFrame, n_rows: int) -> DataFrame:
    """``placed`` with slot: 0, 1, ... within each shard. Rows are numbered in blocks, and blocks start where the last ended."""
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    rows = placed.withColumn("block", F.pmod(F.xxhash64("dealt"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return rows.withColumn("slot", number.cast("long") - 1).join(starts, ["shard", "block"]).withColumn("slot", F.col("slot") + F.col("start")).drop("start", "block", "dealt")


def query(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    placed = staged(assign(read(spark, sf_dir, "documents"), shards), "placed")
    return slotted(placed, placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "tokens"
    )
