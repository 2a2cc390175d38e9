"""Audit of how filters interact, by relations of failing ids.

Each filter has one table of the ids of the rows that fail it. From these tables alone, for every set of filters that may stand
before a filter in some order (a prefix):

* survivors of the prefix: ids that a left-anti join with its filters' tables leaves;
* removed by the next filter: its failing ids, left-anti joined with the prefix's;
* redundant: its failing ids, left-semi joined with the prefix's;
* label losses: the removed among the ids that a left-semi join with a label's ids gives;
* unique fails: the removed after all other filters;
* the sum over all orders is the removed of each prefix times the orders that have it in front.

The order inside a prefix does not matter, so 32 prefixes serve 120 orders. A join is on the id; which filters count is a
condition on the numbers of prefix and filter, so the failing ids are shuffled once, by id, for all prefixes. An id has at most
one row in each table: no key is hot. Ids that fail nothing survive every prefix and are counted, not joined. Counts are by part
and are summed before they are shuffled; the report has as many rows a part as the orders have steps.

Rows get an id of their own when they are staged, so null and repeated doc_ids are rows like others. A null text counts as empty,
a null part as the empty string. Duplicates: a row fails if a row of smaller doc_id, removed or not, has the same text; null
doc_ids neither fail nor make others fail. Labels: a doc_id has a label if any row of ``labels`` says so; null ones count for
none. An empty table gives an empty report.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipflow.llm.common import map_slices, shared_dir, staged
from clipflow.llm.common import table as read

#: Texts that more rows have than this share of all are joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 1 / 1000
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"

#: Failure conditions on the counts of ``measured``, in the order of the filters' letters; E is ``repeats``.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_points",
    "D": "marked",
    "E": "repeats",
}


def measured(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """key, part, digest of the text and the counts that the filters look at, one pass over the texts."""

    def step(batch):
        texts = [(v or "") for v in batch.column("text").to_pylist()]
        words, distinct, upper, marked = [], [], [], []
        for t in texts:
            raw = t.encode()
            w = raw.split()  # at bytes 9 to 13 and 32, as [^\x20\x09-\x0D]+ does
            words.append(len(w)), distinct.append(len(set(w)))
            upper.append(len(raw) - len(raw.translate(None, UPPER)))
            marked.append(len(raw.translate(None, MARKS)) < len(raw))
        return {"key": batch.column("key"), "part": batch.column("part"), "digest": batch.column("digest"), "n_words": words, "n_distinct": distinct, "n_upper": upper, "n_points": [len(t) for t in texts], "marked": marked}

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.md5(whole.cast("binary")).alias("digest"), whole.alias("text"))
    schema = "key long, part string, digest string, n_words long, n_distinct long, n_upper long, n_points long, marked boolean"
    return map_slices(named, step, schema)


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeats``: a smaller key has the same digest."""
    held = rows.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    held = staged(held, "repeated")
    hot = held.where(F.col("n") > max(1, int(rows.count() * HOT_SHARE))).select("digest", "least")  # fewer than 1 / HOT_SHARE rows
    cold = held.join(F.broadcast(hot), "digest", "left_anti").select("digest", "least")
    of_hot = rows.join(F.broadcast(hot), "digest")
    of_cold = rows.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest", "left")
    return of_hot.select(*rows.columns, "least").union(of_cold.select(*rows.columns, "least")).withColumn("repeats", F.coalesce(F.col("least") < F.col("key"), F.lit(False))).drop("least")


def failing(rows: DataFrame, filters: dict[str, str]) -> dict[str, DataFrame]:
    """One stored table of (id, part) for each filter: the rows for which its condition holds. One pass writes them all."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "failing")
    held = F.filter(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in filters.items())), lambda x: x.isNotNull())
    rows.select("id", "part", F.explode(held).alias("filter")).write.partitionBy("filter").option("partitionOverwriteMode", "static").parquet(path)
    stored = spark.read.schema("id long, part string, filter string").parquet(path)
    return {name: stored.where(F.col("filter") == name).select("id", "part") for name in filters}


def bits(prefix: str, names: str) -> int:
    return sum(1 << names.index(f) for f in prefix)


def audit(rows: DataFrame, fails: dict[str, DataFrame], losses: dict[str, DataFrame]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a column for each of ``losses`` and shapley.

    rows: id (unique) and part. fails: (id, part) of the rows failing each filter, named by one letter. losses: ids with a label.
    """
    names = "".join(fails)
    every = [bits("".join(c), names) for n in range(len(names) + 1) for c in itertools.combinations(names, n)]
    tagged = [fails[f].select("id", "part", F.lit(1 << k).alias("bit")) for k, f in enumerate(names)]
    ids = tagged[0]
    for t in tagged[1:]:
        ids = ids.union(t)
    ids = ids.repartition("id")  # once, for all joins below
    before = ids.select("id", F.col("bit").alias("own"))
    member = lambda: F.col("prefix").bitwiseAND(F.col("own")) != 0
    prefixes = lambda out: F.explode(F.filter(F.array(*map(F.lit, every)), lambda s: s.bitwiseAND(out) == 0)).alias("prefix")

    def joined(failed: DataFrame, how: str) -> DataFrame:
        """``failed`` ids of each filter, with each prefix that does not hold it, left by the join with the prefix's ids."""
        a = failed.select("id", "part", "bit", prefixes(F.col("bit"))).alias("a")
        b = before.alias("b")
        return a.join(b, (F.col("a.id") == F.col("b.id")) & member(), how).select("a.id", "part", "bit", "prefix")

    counted = lambda df, what: df.groupBy("part", "bit", "prefix").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    counts = counted(joined(ids, "left_anti"), "removed").union(counted(joined(ids, "left_semi"), "redundant"))
    for name, labelled in losses.items():
        counts = counts.union(counted(joined(ids.join(labelled, "id", "left_semi"), "left_anti"), name))
    touched = ids.select("id", "part").distinct()
    alive = touched.select("id", "part", prefixes(F.lit(0))).alias("a").join(before.alias("b"), (F.col("a.id") == F.col("b.id")) & member(), "left_anti")
    alive = alive.select("part", F.lit(-1).alias("bit"), "prefix")
    counts = counts.union(alive.groupBy("part", "bit", "prefix").agg(F.count("*").alias("n")).withColumn("what", F.lit("survivors")))
    clean = rows.join(touched.select("id"), "id", "left_anti").groupBy("part").agg(F.count("*").alias("n"))
    counts = counts.union(clean.select("part", F.lit(-1).alias("bit"), F.lit(-1).alias("prefix"), "n", F.lit("clean").alias("what")))
    kinds = ["removed", "redundant", *losses, "survivors", "clean"]
    found = staged(counts.groupBy("part", "bit", "prefix").pivot("what", kinds).agg(F.sum("n")).na.fill(0), "audit")

    parts = staged(rows.select("part").distinct(), "parts")
    return report(parts, found, names, list(losses))


def report(parts: DataFrame, found: DataFrame, names: str, losses: list[str]) -> DataFrame:
    """The counts of each prefix laid out along all orders, zeros included."""
    spark, everything = parts.sparkSession, (1 << len(names)) - 1
    orders = [("".join(o), k + 1, bits(f, names), bits("".join(o[:k]), names), bits("".join(o[: k + 1]), names)) for o in itertools.permutations(names) for k, f in enumerate(o)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, bit int, prefix int, after int")  # 600 rows for five filters
    cells = sorted({(b, p, a) for _, _, b, p, a in orders})
    cell = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(p).alias("prefix"), F.lit(a).alias("after")) for b, p, a in cells)))
    grid = parts.select("part", cell.alias("c")).select("part", "c.*")
    own = found.where("bit >= 0").select("part", "bit", "prefix", "removed", "redundant", *losses)
    alive = found.where("prefix >= 0 and bit < 0").select("part", F.col("prefix").alias("after"), "survivors")
    clean = found.where("prefix < 0").select("part", "clean")
    filled = grid.join(own, ["part", "bit", "prefix"], "left").join(alive, ["part", "after"], "left").join(clean, "part", "left").na.fill(0).drop("after")
    n = len(names)
    rest = F.lit(everything) - F.col("bit")
    in_front = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.bit_count("prefix") + 1)
    sums = filled.groupBy("part", "bit").agg(
        F.sum(F.when(F.col("prefix") == rest, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * in_front).alias("shapley")
    )
    out = filled.join(sums, ["part", "bit"]).join(F.broadcast(steps.drop("after")), ["bit", "prefix"])
    long: Column = F.col("survivors") + F.col("clean")
    return out.select("part", "filter_order", "step", long.alias("kept"), "removed", "redundant", "unique_fails", *losses, "shapley")


def labelled(rows: DataFrame, labels: DataFrame, which: str) -> DataFrame:
    """Ids of the rows whose key has label ``which`` = 1; rows are dealt by key, of which each label has one row."""
    keys = labels.where(F.col(which) == 1).select(F.col("doc_id").cast("long").alias("key")).distinct()
    return rows.join(keys, "key", "left_semi").select("id")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = staged(measured(docs, "text", "doc_id", "source").withColumn("id", F.monotonically_increasing_id()), "measured")
    rows = staged(with_repeats(rows), "repeats")
    losses = {"good_lost": labelled(rows, labels, "quality"), "toxic_lost": labelled(rows, labels, "toxic")}
    return audit(rows.select("id", "part"), failing(rows, FILTERS), losses)


#: Survivors by prefix from failing flags; the same report.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT id, part,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN least < doc_id THEN 16 ELSE 0 END) AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A','B','C','D','E']) AS letter, unnest([1,2,4,8,16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step-1]), 0)::BIGINT AS prefix FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (prefix + bit)::BIGINT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & prefix) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & prefix) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & prefix) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & prefix) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
