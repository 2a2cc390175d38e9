"""The four quantile definitions in use. They differ; none stands in for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear(value: str, p: float, where: Column | None = None) -> Column:
    """Interpolated between neighbours."""
    return F.percentile(value if where is None else F.when(where, F.col(value)), F.lit(p))


def ranks(n: Column, p: float, kind: str) -> Column:
    """The 0-based rank that a definition picks out of ``n`` sorted values."""
    if kind == "nearest":  # half to even
        return F.bround(F.lit(p) * (n - 1), 0).cast("long")
    if kind == "floor":
        return F.least(n - 1, F.floor(F.lit(p) * n)).cast("long")
    if kind == "ci":  # not clamped: may be past the end
        return F.floor(F.lit(p) * n).cast("long")
    raise ValueError(kind)


def picked(df: DataFrame, by: list[str], value: str, picks: dict[str, tuple[float, str]], ranges: int = 512) -> DataFrame:
    """One row per group with the picked order statistics, exact, with no window or aggregate over a whole group.

    A group's values are cut into ``ranges`` ranges at values near its quantiles, so a hot value is one range and any other holds about a
    share 1 / ranges. Counts by range, running over the ranges, tell which range holds each rank and how many values lie below it;
    only those ranges are sorted, each in its own window. ``linear`` picks are interpolated between their two ranks. For few, large
    groups: their cuts are broadcast. Groups that are small and many: ``picked_within``.
    """
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    cuts = d.groupBy(*by).agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("__cuts"))
    # the number of cuts below a value; a value that many cuts equal is its own range
    placed = d.join(F.broadcast(cuts), by)
    placed = placed.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    counts = placed.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    group = W.partitionBy(*by)  # over the ranges of a group
    start = F.coalesce(F.sum("__n").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumns({"__before": start, "__all": F.sum("__n").over(group)})
    wanted = {}
    for name, (p, kind) in picks.items():
        if kind == "linear":
            at = F.lit(p) * (F.col("__all") - 1)
            wanted |= {f"{name} low": F.floor(at).cast("long"), f"{name} high": F.ceil(at).cast("long")}
        else:
            wanted[name] = ranks(F.col("__all"), p, kind)
    asked = F.array(*(F.struct(F.lit(n).alias("pick"), r.alias("rank")) for n, r in wanted.items()))
    within = F.filter(asked, lambda a: (a["rank"] >= F.col("__before")) & (a["rank"] < F.col("__before") + F.col("__n")))
    hits = held.withColumn("__asked", within).where(F.size("__asked") > 0)
    # a range of one value needs no sorting
    sure = hits.where("__least = __most").select(*by, "__all", F.explode("__asked").alias("a"), F.col("__least").alias("__v"))
    open_ = hits.where("__least < __most").select(*by, "__range", "__before", "__all", "__asked")
    inside = placed.join(open_, [*by, "__range"])
    rank = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__v")) - 1 + F.col("__before")
    found = inside.withColumn("__rank", rank).select(*by, "__all", F.explode(F.filter("__asked", lambda a: a["rank"] == F.col("__rank"))).alias("a"), "__v")
    both = sure.unionByName(found).select(*by, "__all", F.col("a.pick").alias("pick"), "__v")
    of = lambda n: F.max(F.when(F.col("pick") == n, F.col("__v")))
    out = []
    for name, (p, kind) in picks.items():
        if kind != "linear":
            out.append(of(name).alias(name))
            continue
        at = F.lit(p) * (F.max("__all") - 1)
        low, high = of(f"{name} low"), of(f"{name} high")
        out.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return both.groupBy(*by).agg(*out)


def picked_within(df: DataFrame, by: list[str], value: str, picks: dict[str, tuple[float, str]]) -> DataFrame:
    """The same for many groups of a session's size: one window a group."""
    d = df.where(F.col(value).isNotNull())
    d = d.withColumns({"__rank": F.row_number().over(W.partitionBy(*by).orderBy(value)).cast("long") - 1, "__n": F.count("*").over(W.partitionBy(*by))})
    return d.groupBy(*by).agg(*(F.max(F.when(F.col("__rank") == ranks(F.col("__n"), p, kind), F.col(value))).alias(name) for name, (p, kind) in picks.items()))
