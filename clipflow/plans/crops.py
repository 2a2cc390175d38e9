"""Queries of crops, problem lists, stats sinks and the figures that stand beside the scores of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.functions import boxes as B
from clipflow.functions import text as X
from clipflow.operators import compare as C
from clipflow.operators import landmarks as L
from clipflow.operators import manifest as A
from clipflow.operators import textmetrics as M
from clipflow.plans.landmarks import H_, HB, MOVED, V, W_, boxed, vectors
from clipflow.plans.registry import query
from clipflow.plans.tables import CLIPS, clips, table
from clipflow.plans.text import BEST, nouns_sql
from clipflow.sources import sinks as K
from clipflow.sources.shared import shared_dir

PARTS = {"left_eye": tuple(range(5)), "right_eye": tuple(range(5, 10)), "mouth": tuple(range(10, 14))}


def low_high(points: str, n: str) -> str:
    cut = lambda i, size: f"list_transform({points}, lambda q: CAST(trunc((q[{i}] + 0.5) * {size}) AS INTEGER))"
    return f"list_min({cut(1, W_)}) AS {n}1, list_min({cut(2, H_)}) AS {n}2, list_max({cut(1, W_)}) AS {n}3, list_max({cut(2, H_)}) AS {n}4"


@query("face_parts", f"""WITH {V}, b AS (SELECT clip, frame, {low_high('p[1:5]', 'l')}, {low_high('p[6:10]', 'r')}, {low_high('p[11:14]', 'm')} FROM pt),
u AS (SELECT *, greatest(0, least(l1, r1, m1) - 10) AS x1, greatest(0, least(l2, r2, m2) - 10) AS y1, least({W_}, greatest(l3, r3, m3) + 10) AS x2, least({H_}, greatest(l4, r4, m4) + 10) AS y2 FROM b),
g AS (SELECT *, greatest(((y2 - y1) - (x2 - x1)) // 2, 0) AS gx, greatest(((x2 - x1) - (y2 - y1)) // 2, 0) AS gy FROM u)
SELECT clip, frame, l1 AS eye_x1, r3 AS eye_x2, m2 AS mouth_y1, m4 AS mouth_y2, greatest(0, x1 - gx) AS x1, greatest(0, y1 - gy) AS y1, least({W_}, x2 + gx) AS x2, least({H_}, y2 + gy) AS y2 FROM g""")
def face_parts(spark, sf):
    """Boxes of both eyes and the mouth, and the padded square around them."""
    d = vectors(spark, sf).select("clip", "frame", F.transform("p", lambda q: F.array(q[0] + 0.5, q[1] + 0.5)).alias("p"))
    d = d.select("clip", "frame", *(B.part_box(F.col("p"), which, W_, H_).alias(n) for n, which in PARTS.items()))
    union = B.padded_union([F.col(n) for n in PARTS], W_, H_).alias("u")
    edges = [F.col("left_eye.x1").alias("eye_x1"), F.col("right_eye.x2").alias("eye_x2"), F.col("mouth.y1").alias("mouth_y1"), F.col("mouth.y2").alias("mouth_y2")]
    return d.select("clip", "frame", *edges, union).select("clip", "frame", "eye_x1", "eye_x2", "mouth_y1", "mouth_y2", "u.*")


STILL = "(CAST('0x' || left(md5('5:left_hand:0:{0}'), 8) AS BIGINT)::DOUBLE / 4294967295.0 * 2 - 1)"


@query("jitter_streams", f"""WITH {MOVED}, d AS (SELECT *, 1 + 0.1::DOUBLE * {STILL.format('scale')} AS s, 8.0::DOUBLE * {STILL.format('x')} AS dx, 8.0::DOUBLE * {STILL.format('y')} AS dy FROM bx),
a AS (SELECT clip, frame, greatest(0, least(CAST(round_even((x1 + x2) / 2.0::DOUBLE - (x2 - x1) / 2.0::DOUBLE * s + dx, 0) AS INTEGER), {W_ - 1})) AS x1, least(CAST(round_even((x1 + x2) / 2.0::DOUBLE + (x2 - x1) / 2.0::DOUBLE * s + dx, 0) AS INTEGER), {W_}) AS x2,
  greatest(0, least(CAST(round_even((y1 + y2) / 2.0::DOUBLE - (y2 - y1) / 2.0::DOUBLE * s + dy, 0) AS INTEGER), {H_ - 1})) AS y1, least(CAST(round_even((y1 + y2) / 2.0::DOUBLE + (y2 - y1) / 2.0::DOUBLE * s + dy, 0) AS INTEGER), {H_}) AS y2 FROM d)
SELECT clip, frame, 'left_hand' AS stream, x1, y1, greatest(x2, x1 + 1) AS x2, greatest(y2, y1 + 1) AS y2 FROM a UNION ALL SELECT clip, frame, 'mouth', x1, y1, x2, y2 FROM bx""")
def jitter_streams(spark, sf):
    """One displacement for all frames, of the hands alone; the mouth's boxes stay."""
    d = boxed(spark, sf).select("clip", "frame", B.shifted_inside(F.col("box"), W_, H_).alias("box"), F.explode(F.array(F.lit("left_hand"), F.lit("mouth"))).alias("stream"))
    moved = B.jittered(F.col("box"), 5, F.col("stream"), F.col("frame"), 0.1, 8.0, W_, H_, static=True, streams=("left_hand", "right_hand"))
    return d.select("clip", "frame", "stream", moved.alias("box")).select("clip", "frame", "stream", "box.*")


LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)"


@query("crop_fallback", f"""WITH {HB}, s AS (SELECT clip, frame, CASE WHEN frame % 7 NOT IN (0, 3) THEN frame END AS seen, CASE WHEN frame % 4 <> 1 THEN x1 END AS x1, y1, x2, y2 FROM hb),
c AS (SELECT *, {LAST.format('seen')} AS src FROM s), j AS (SELECT c.clip, c.frame, s.x1, s.y1, s.x2, s.y2, CASE WHEN c.src % 5 <> 2 AND s.x1 IS NOT NULL THEN c.frame END AS image FROM c LEFT JOIN s ON s.clip = c.clip AND s.frame = c.src),
w AS (SELECT clip, frame, {LAST.format('image')} AS image FROM j)
SELECT w.clip, w.frame, w.image, j.x1, j.y1, j.x2, j.y2 FROM w LEFT JOIN j ON j.clip = w.clip AND j.frame = w.image""")
def crop_fallback(spark, sf):
    """Frames missed as a whole (also the first), frames without a pose, and a hand that is not found."""
    hand, pose = F.when(F.col("frame") % 4 != 1, F.col("box")).alias("hand"), (F.col("frame") % 5 != 2).alias("pose")
    d = boxed(spark, sf).withColumn("landmarks", F.when(~(F.col("frame") % 7).isin(0, 3), F.struct(pose, hand)))
    return L.crop_sources(d, ["clip"], "frame", "landmarks", ["hand"]).select("clip", "frame", "hand_crop.image", "hand_crop.box.*")


@query("problem_lines", """WITH i AS (SELECT doc_id, 'in/' || source || '/v' || doc_id || '.mp4' AS path FROM documents), l AS (SELECT 'failed: ' || path || ' (no frames)' AS line FROM i WHERE doc_id % 9 = 0)
SELECT path FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE contains(line, path))""")
def problem_lines(spark, sf):
    """The list's lines hold more than the path."""
    i = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("in/"), "source", F.lit("/v"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"))
    lines = i.where("doc_id % 9 = 0").select(F.concat(F.lit("failed: "), "path", F.lit(" (no frames)")).alias("line"))
    return A.not_named(i.select("path"), lines)


@query("sink_stats", f"""WITH {V}, s AS (SELECT clip, frame, len(list_filter(v, lambda x: x > 0.1)) AS hands, len(list_filter(v, lambda x: x < -0.1)) AS faces FROM v)
SELECT clip, frame, CAST(max(hands) AS BIGINT) AS hands, CAST(max(faces) AS BIGINT) AS faces FROM s GROUP BY GROUPING SETS ((clip, frame), (clip))""")
def sink_stats(spark, sf):
    path = shared_dir(spark, "stats")
    count = lambda f: F.coalesce(F.size(F.filter("v", f)), F.lit(0)).cast("long")
    K.write_stats(vectors(spark, sf).select("clip", "frame", count(lambda x: x > 0.1).alias("hands"), count(lambda x: x < -0.1).alias("faces")), path)
    return spark.read.schema("frame long, hands long, faces long, clip long").json(path).select("clip", "frame", "hands", "faces")


@query("run_speed", f"""WITH {CLIPS}, t AS (SELECT category, run, CASE WHEN run = 'a' THEN length(hyp_a) * 7 + 100 WHEN id % 3 <> 0 THEN length(hyp_b) * 5 + 100 END AS ms FROM clips, (VALUES ('a'), ('b')) AS r(run)),
m AS (SELECT coalesce(category, 'ALL') AS category, sum(ms) FILTER (WHERE run = 'a')::DOUBLE / nullif(count(ms) FILTER (WHERE run = 'a') * 1000, 0) AS a, sum(ms) FILTER (WHERE run = 'b')::DOUBLE / nullif(count(ms) FILTER (WHERE run = 'b') * 1000, 0) AS b FROM t GROUP BY GROUPING SETS ((), (category)))
SELECT category, round(a, 4) AS seconds_a, round(b, 4) AS seconds_b, round(a / nullif(b, 0), 4) AS speed_up FROM m""")
def run_speed(spark, sf):
    """Times stand in by length; a third of the clips of b have none."""
    ms = F.array(F.struct(F.lit("a").alias("run"), (F.length("hyp_a") * 7 + 100).alias("millis")), F.struct(F.lit("b").alias("run"), F.when(F.col("id") % 3 != 0, F.length("hyp_b") * 5 + 100).alias("millis")))
    return C.speeds(clips(spark, sf).select("category", F.inline(ms)))


@query("run_recall", f"""WITH {CLIPS}, n AS (SELECT run, {nouns_sql('reference')} AS nouns, regexp_extract_all(lower(CASE run WHEN 'a' THEN hyp_a ELSE hyp_b END), '[A-Za-z'']+') AS tokens FROM clips, (VALUES ('a'), ('b')) AS r(run)),
nb AS (SELECT run, round(unnest({BEST}), 6) AS best FROM n), r AS (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE run = 'a' AND best = 1) / count(*) FILTER (WHERE run = 'a') AS a, 100.0::DOUBLE * count(*) FILTER (WHERE run = 'b' AND best = 1) / count(*) FILTER (WHERE run = 'b') AS b FROM nb HAVING count(*) > 0)
SELECT 'proper_noun_recall' AS metric, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta FROM r""")
def run_recall(spark, sf):
    c = clips(spark, sf).select(X.proper_nouns("reference").alias("nouns"), *(X.letters(F.lower(f"hyp_{r}")).alias(r) for r in "ab"))
    runs = F.array(*(F.struct(F.lit(r).alias("run"), M.best_similarity(F.col("nouns"), F.col(r)).alias("all")) for r in "ab"))
    return C.recalls(c.select(F.inline(runs)).select("run", F.explode("all").alias("best")).withColumn("best", F.round("best", 6)))
