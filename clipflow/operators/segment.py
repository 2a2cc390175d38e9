"""Segmentation with fixed thresholds as windows and aggregates, onset and trims. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipflow.operators.windows import debounced, over


def segments(df: DataFrame, start: float, stop: float, frames: int, still: int, score: str = "smoothed") -> DataFrame:
    """Clips of a hysteresis gate: session_id, start_idx, end_idx, start_t, end_t.

    A motion frame opens an island if the frame just before it comes ``still`` or later after the last motion frame: only then
    has the gate been asked and has closed. A data gap between two moving frames closes nothing, which is why this is not a
    session window. A clip is an island from its first debounced frame to its last motion frame.
    """
    moving = df.withColumns({"__before": F.lag("t").over(over()), "__start": debounced(score, start, frames)}).where(F.col(score) > stop)
    opens = F.lag("t").over(over()).isNull() | (F.col("__before") - F.lag("t").over(over()) >= still)
    island = moving.withColumn("__opens", F.when(opens, 1).otherwise(0)).withColumn("__island", F.sum("__opens").over(over(rows=(W.unboundedPreceding, 0))))
    first = lambda c: F.min(F.when(F.col("__start"), F.col(c)))
    clips = island.groupBy("session_id", "__island").agg(first("idx").alias("start_idx"), F.max("idx").alias("end_idx"), first("t").alias("start_t"), F.max("t").alias("end_t"))
    return clips.where("start_idx IS NOT NULL").drop("__island")


def segments_by_count(df: DataFrame, start: float, stop: float, still_frames: int, least_frames: int, score: str = "score") -> DataFrame:
    """Frame-count rule: opens on one frame above ``start``, ends with the ``still_frames``-th frame in a row below ``stop``, tail included."""
    ends = df.withColumn("__last", F.max("idx").over(W.partitionBy("session_id")))
    moving = ends.where(F.col(score) >= stop)
    gap = F.col("idx") - F.lag("idx").over(over())
    island = moving.withColumn("__opens", F.when(gap.isNull() | (gap > still_frames), 1).otherwise(0)).withColumn("__island", F.sum("__opens").over(over(rows=(W.unboundedPreceding, 0))))
    clips = island.groupBy("session_id", "__island").agg(F.min(F.when(F.col(score) > start, F.col("idx"))).alias("start_idx"), (F.max("idx") + still_frames).alias("end_idx"), F.max("__last").alias("__last"))
    length = F.col("end_idx") - F.col("start_idx") + 1
    return clips.where("start_idx IS NOT NULL AND end_idx <= __last").where(length >= least_frames).select("session_id", "start_idx", "end_idx", length.alias("frames"))


def segments_by_time(df: DataFrame, start: float, stop: float, still: int, least: int, score: str = "score") -> DataFrame:
    """Time rule: ends at the first frame ``still`` or later after the last motion; that tail counts. A clip still open at the end is lost."""
    clips = segments(df, start, stop, 1, still, score).select("session_id", (F.col("end_t") + still).alias("t"), F.lit(None).cast("long").alias("idx"), F.struct("start_idx", "start_t").alias("__clip"))
    both = df.select("session_id", "t", F.col("idx").cast("long").alias("idx"), F.lit(None).cast(clips.schema["__clip"].dataType).alias("__clip")).unionByName(clips)
    # backwards in time, a clip's due time comes after the frames from it on: the last of those is the first frame not before it
    back = W.partitionBy("session_id").orderBy(F.desc("t"), F.col("__clip").isNotNull(), F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)
    ended = both.withColumn("e", F.last(F.when(F.col("__clip").isNull(), F.struct("idx", "t")), ignorenulls=True).over(back)).where("__clip IS NOT NULL AND e IS NOT NULL")
    return ended.select("session_id", F.col("__clip.start_idx").alias("start_idx"), F.col("e.idx").alias("end_idx"), (F.col("e.t") - F.col("__clip.start_t")).alias("elapsed")).where(F.col("elapsed") >= least)


def moving_fraction(clips: DataFrame, frames: DataFrame, stop: float, score: str = "score") -> DataFrame:
    """Adds moving_fraction: the share of a clip's scored frames above ``stop``; 1 if none is scored.

    clips: start_idx and end_idx are frames of the session (a clip whose frames are not there goes). Scored and moving frames are
    totalled along the session and looked up at the clip's two edges.
    """
    scored, moves = (F.when(c, 1).otherwise(0) for c in (F.col(score).isNotNull(), F.col(score) > stop))
    upto = over(rows=(W.unboundedPreceding, 0))
    totals = frames.select("session_id", F.col("idx").alias("__i"), scored.alias("__s"), moves.alias("__m"), F.sum(scored).over(upto).alias("__scored"), F.sum(moves).over(upto).alias("__moving"))
    edges = clips.select("*", F.inline(F.array(F.struct(F.col("start_idx").alias("__i"), F.lit(-1).alias("__sign")), F.struct(F.col("end_idx").alias("__i"), F.lit(1).alias("__sign")))))
    before = lambda total, own: F.when(F.col("__sign") > 0, F.col(total)).otherwise(F.col(own) - F.col(total))
    held = edges.join(totals, ["session_id", "__i"]).groupBy(*clips.columns).agg(F.sum(before("__scored", "__s")).alias("__s"), F.sum(before("__moving", "__m")).alias("__m"))
    return held.select(*clips.columns, F.round(F.coalesce(F.try_divide("__m", "__s"), F.lit(1.0)), 6).alias("moving_fraction"))


def accepted(clips: DataFrame, least: int, fraction: float = 0.5) -> DataFrame:
    """Adds accepted, and clip_no over the accepted clips of a session."""
    ok = (F.col("end_t") - F.col("start_t") >= least) & (F.col("moving_fraction") >= fraction)
    number = F.sum(F.when(F.col("accepted"), 1).otherwise(0)).over(W.partitionBy("session_id").orderBy("start_idx").rowsBetween(W.unboundedPreceding, 0))
    return clips.withColumn("accepted", ok).withColumn("clip_no", F.when(F.col("accepted"), number))


def empty_note(span: Column, fraction: Column, least: float = 1.0, moving: float = 0.5) -> Column:
    """Why a clip is suspect: its trimmed span (seconds) is short, else few frames move; null if neither."""
    return F.when(span < least, F.format_string("no signing detected, trim span %.2fs", span)).when(
        fraction < moving, F.format_string("only %d%% of frames moving", F.floor(fraction * 100).cast("int"))
    )


def motion_onset(triggers: DataFrame, frames: DataFrame, stop: float, ring: int = 75, quiet: int = 9, lead: int = 7) -> DataFrame:
    """triggers: session_id, trigger_idx. Adds onset_idx: where motion began in the ring of frames that ends at the trigger.

    That is the frame after the latest run of ``quiet`` raw frames at or below ``stop`` that lies in the ring (its last frame at
    most), or the ring's first; then ``lead`` frames earlier, not before the ring.
    """
    w = over(rows=(1 - quiet, 0))
    rests = (F.max("score").over(w) <= stop) & (F.count("score").over(w) == quiet)
    marked = frames.select("session_id", "idx", F.when(rests, F.col("idx")).alias("__quiet"))
    latest = marked.select("session_id", F.col("idx").alias("trigger_idx"), F.last("__quiet", ignorenulls=True).over(over(rows=(W.unboundedPreceding, 0))).alias("__end"))
    low = F.greatest(F.col("trigger_idx") - (ring - 1), F.lit(0))
    found = triggers.select("session_id", "trigger_idx").join(latest, ["session_id", "trigger_idx"], "left").withColumn("__low", low)
    onset = F.when(F.col("__end") - (quiet - 1) >= F.col("__low"), F.least(F.col("__end") + 1, F.col("trigger_idx"))).otherwise(F.col("__low"))
    return found.select("session_id", "trigger_idx", F.greatest(onset - lead, F.col("__low")).alias("onset_idx"))


def head_trim(frames: DataFrame, stop: float, window: int, quiet: int, pad: int) -> DataFrame:
    """Per session: onset_idx and keep_idx, the first frame within ``pad`` of it; 0 without an onset. Null scores are skipped."""
    scored = frames.where("score IS NOT NULL").withColumn("__motion", F.col("score") > stop)
    before = F.coalesce(F.sum(F.when(F.col("__motion"), 1).otherwise(0)).over(over(rows=(W.unboundedPreceding, -1))), F.lit(0))
    grouped = scored.withColumn("__run", before).withColumn("__t0", F.min("t").over(W.partitionBy("session_id")))
    since = grouped.withColumn("__since", F.min(F.when(~F.col("__motion"), F.col("t"))).over(W.partitionBy("session_id", "__run")))
    hits = since.where(F.col("__motion") & (F.col("t") - F.col("__since") >= quiet) & (F.col("t") - F.col("__t0") <= window))
    onset = hits.groupBy("session_id").agg(F.min("idx").alias("onset_idx"), F.min("t").alias("__t"))
    kept = frames.join(onset, "session_id", "left").groupBy("session_id").agg(
        F.max("onset_idx").alias("onset_idx"), F.coalesce(F.min(F.when(F.col("t") >= F.col("__t") - pad, F.col("idx"))), F.lit(0)).cast("long").alias("keep_idx")
    )
    return kept


def tail_trim(frames: DataFrame, stop: float, pad: int, most: int, least: int) -> DataFrame:
    """Per session: the frames that the automatic and the manual tail trims keep.

    Automatic: up to ``pad`` after the last motion. Manual: not more than ``most`` before the end is cut, and nothing at all if what
    would remain is shorter than ``least``.
    """
    ends = frames.groupBy("session_id").agg(F.max(F.when(F.col("score") > stop, F.col("t"))).alias("__motion"), F.min("t").alias("__first"), F.max("t").alias("__last"))
    auto = F.coalesce(F.col("__motion") + pad, F.col("__last"))
    cut = F.greatest(auto, F.col("__last") - most)
    manual = F.when(cut - F.col("__first") < least, F.col("__last")).otherwise(cut)
    both = ends.select("session_id", auto.alias("__auto"), manual.alias("__manual"))
    return frames.join(both, "session_id").groupBy("session_id").agg(
        F.count_if(F.col("t") <= F.col("__auto")).alias("auto_kept"), F.count_if(F.col("t") <= F.col("__manual")).alias("manual_kept"), F.count("*").alias("frames")
    )


def percentile_trim(frames: DataFrame, pad: int, floor: float = 0.5, share: float = 0.25, least: float = 0.4) -> DataFrame:
    """Per session: the threshold between its quiet and busy percentiles, and the frames kept around those above it."""
    p = frames.groupBy("session_id").agg(F.percentile("score", F.array(F.lit(0.2), F.lit(0.9))).alias("p"), F.count("*").alias("frames"))
    thr = p.select("session_id", "frames", F.round(F.greatest(F.lit(floor), F.col("p")[0] + share * (F.col("p")[1] - F.col("p")[0])), 6).alias("threshold"))
    above = frames.join(thr, "session_id").groupBy("session_id", "frames", "threshold").agg(*(f(F.when(F.col("score") > F.col("threshold"), F.col("idx"))).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))))
    first, last = F.greatest(F.col("a") - pad, F.lit(0)), F.least(F.col("b") + pad, F.col("frames") - 1)
    whole = F.col("a").isNull() | ((last - first + 1) < least * F.col("frames"))
    return above.select("session_id", "threshold", F.when(whole, 0).otherwise(first).cast("long").alias("first_idx"), F.when(whole, F.col("frames") - 1).otherwise(last).cast("long").alias("last_idx"))


def segment_score(clips: DataFrame, frames: DataFrame, positive: Column) -> DataFrame:
    """Clips against labels: n_clips, coverage_pct of positive frames, false_starts, fragments and the longest lead_lost (frames).

    frames: with span. Every join has the session as an equality.
    """
    f = frames.withColumn("__pos", positive)
    c = clips.select("session_id", "start_idx", "end_idx")
    pos = f.where("__pos")
    hit = pos.join(c, [pos["session_id"] == c["session_id"], F.col("idx") >= F.col("start_idx"), F.col("idx") <= F.col("end_idx")], "left_semi").agg(F.count("*").alias("covered"))
    false = c.join(pos.select(F.col("session_id").alias("s"), "idx"), [F.col("session_id") == F.col("s"), F.col("idx") >= F.col("start_idx"), F.col("idx") <= F.col("end_idx")], "left_anti").agg(F.count("*").alias("false_starts"))
    spans = pos.groupBy("session_id", "span").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    met = spans.join(c, "session_id").where("start_idx <= b AND end_idx >= a").groupBy("session_id", "span", "a").agg(F.count("*").alias("n"), F.min("start_idx").alias("s"))
    parts = met.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("fragments"), F.coalesce(F.max(F.greatest(F.col("s") - F.col("a"), F.lit(0))), F.lit(0)).alias("lead_lost"))
    totals = c.agg(F.count("*").alias("n_clips")).crossJoin(pos.agg(F.count("*").alias("positive"))).crossJoin(hit).crossJoin(false).crossJoin(parts)  # five one-row tables
    return totals.select("n_clips", F.round(100.0 * F.try_divide("covered", "positive"), 6).alias("coverage_pct"), "false_starts", "fragments", "lead_lost")


def replay_scores(clips: DataFrame, frames: DataFrame, configs: list[str], positive: Column) -> DataFrame:
    """Per configuration: clips, the share of positive frames that lie in one (percent) and the clips without any.

    Positive frames are numbered in each session; a clip holds those up to its end less those before its start, looked up by the frames
    at its edges, so no clip is held against the frames inside it. What an earlier clip of the configuration holds already is not
    counted again.
    """
    spark = frames.sparkSession
    upto = frames.select("session_id", "idx", F.sum(F.when(positive, 1).otherwise(0)).over(over(rows=(W.unboundedPreceding, 0))).alias("n"))
    at = lambda d, idx, name: d.join(upto.select("session_id", F.col("idx").alias(idx), F.col("n").alias(name)), ["session_id", idx], "left")
    earlier = F.max("end_idx").over(W.partitionBy("session_id", "config").orderBy("start_idx", "end_idx").rowsBetween(W.unboundedPreceding, -1))
    met = clips.select("config", "session_id", "start_idx", "end_idx", (F.col("start_idx") - 1).alias("__a"), F.greatest(F.col("start_idx") - 1, F.when(earlier.isNotNull(), F.least(earlier, "end_idx"))).alias("__b"))
    met = at(at(at(met, "end_idx", "__end"), "__a", "__before"), "__b", "__counted").na.fill(0, ["__before", "__counted"])
    sums = met.groupBy("config").agg(F.count("*").alias("clips"), F.sum(F.col("__end") - F.col("__counted")).alias("__held"), F.count_if(F.col("__end") == F.col("__before")).alias("false_starts"))
    total = frames.agg(F.count_if(positive).alias("__all"))  # one row
    names = spark.createDataFrame([(c,) for c in configs], "config string")
    out = F.broadcast(names).join(sums, "config", "left").na.fill(0).join(F.broadcast(total))
    return out.select("config", "clips", F.round(F.try_divide(100.0 * F.col("__held"), F.col("__all")), 6).alias("coverage_pct"), "false_starts")
