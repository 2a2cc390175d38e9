"""Queries of landmark and vector operators over ``embeddings``: a label is a clip, vec_id orders its frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipflow.functions import boxes as B
from clipflow.operators import landmarks as L
from clipflow.operators import windows as O
from clipflow.plans.registry import query
from clipflow.plans.tables import table

W_, H_ = 640, 480


def vectors(spark, sf):
    """clip, frame (from 0), vec_id, v (doubles), p (32 points)."""
    d = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("clip"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return O.indexed(d, ["clip"], ["vec_id"], "frame").withColumn("p", L.points_of("v"))


V = """v AS (SELECT CAST(label AS BIGINT) AS clip, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pt AS (SELECT *, list_transform(range(0, 32), lambda i: [v[2 * i + 1], v[2 * i + 2]]) AS p FROM v)"""
DIST = "sqrt(pow({0}[1] - {1}[1], 2) + pow({0}[2] - {1}[2], 2))"


@query("frame_diff", f"""WITH {V}, b AS (SELECT *, lag(v) OVER (PARTITION BY clip ORDER BY frame) AS bv, lag(p) OVER (PARTITION BY clip ORDER BY frame) AS bp FROM pt)
SELECT clip, frame, round(CASE WHEN bv IS NULL THEN 0 ELSE list_avg(list_transform(range(1, 65), lambda i: abs(v[i] - bv[i]))) END, 6) AS diff, round(CASE WHEN bp IS NULL THEN 0 ELSE list_avg(list_transform(range(1, 33), lambda i: sqrt(pow(p[i][1] - bp[i][1], 2) + pow(p[i][2] - bp[i][2], 2)))) END, 6) AS moved FROM b""")
def frame_diff(spark, sf):
    v = vectors(spark, sf)
    return v.select("clip", "frame", F.round(O.frame_diff("v", ["clip"], ["frame"]), 6).alias("diff"), F.round(O.displacement("p", ["clip"], ["frame"]), 6).alias("moved"))


IDS = [0, 2, 5, 11, 12, 15, 40]


@query("joint_subset", f"WITH {V} SELECT clip, frame, list_transform({IDS}, lambda i: round(p[i + 1][1], 6)) AS xs FROM pt")
def joint_subset(spark, sf):
    return vectors(spark, sf).select("clip", "frame", F.transform(L.subset(F.col("p"), IDS), lambda q: L.rounded(q[0], 6)).alias("xs"))


@query("norm_points", f"WITH {V} SELECT clip, frame, list_transform(p, lambda q: [round(q[1] / {W_}, 9), round(q[2] / {H_}, 9)]) AS p FROM pt")
def norm_points(spark, sf):
    return vectors(spark, sf).select("clip", "frame", F.transform("p", lambda q: F.array(L.rounded(q[0] / W_, 9), L.rounded(q[1] / H_, 9))).alias("p"))


HANDS = "[p[9:12], p[13:16], p[17:20]]"


def hands(p):
    """Three groups of four points that stand for detected hands."""
    return F.array(*(F.slice(p, i, 4) for i in (9, 13, 17)))


@query("nearest_hand", f"""WITH {V}, h AS (SELECT clip, frame, p, {HANDS} AS hands FROM pt), s AS (SELECT clip, frame, side, CASE side WHEN 'left' THEN p[1] ELSE p[2] END AS w, hands FROM h, (VALUES ('left'), ('right')) AS t(side)),
c AS (SELECT clip, frame, side, i - 1 AS hand, sqrt(pow(w[1] - hands[i][1][1], 2) + pow(w[2] - hands[i][1][2], 2)) AS d FROM s, unnest(range(1, 4)) AS r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY clip, frame, side ORDER BY d, hand) AS rn FROM c) SELECT clip, frame, side, hand, round(d, 6) AS d FROM k WHERE rn = 1 AND d < 0.1""")
def nearest_hand(spark, sf):
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col("p")[i].alias("w")) for i, s in enumerate(("left", "right"))))
    d = vectors(spark, sf).select("clip", "frame", hands(F.col("p")).alias("hands"), F.inline(sides))
    best = d.select("clip", "frame", "side", L.nearest(F.col("w"), F.col("hands"), 0.1).alias("best")).where("best IS NOT NULL")
    return best.select("clip", "frame", "side", F.col("best.i").cast("long").alias("hand"), F.round("best.d", 6).alias("d"))


@query("nearest_face", f"""WITH {V}, c AS (SELECT clip, frame, i - 1 AS face, sqrt(pow(v[1] - v[3 * i + 1], 2) + pow(v[2] - v[3 * i + 2], 2) + pow(v[3] - v[3 * i + 3], 2)) AS d FROM v, unnest(range(1, 5)) AS r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY d, face) AS rn FROM c) SELECT clip, frame, face, round(d, 6) AS d FROM k WHERE rn = 1""")
def nearest_face(spark, sf):
    faces = F.array(*(F.array(F.slice("v", 3 * i + 1, 3)) for i in range(1, 5)))
    d = vectors(spark, sf).select("clip", "frame", L.nearest(F.slice("v", 1, 3), faces, dims=3).alias("best"))
    return d.select("clip", "frame", F.col("best.i").cast("long").alias("face"), F.round("best.d", 6).alias("d"))


POSES = V + ", poses AS (SELECT clip, frame, CASE WHEN vec_id % 7 = 3 THEN NULL ELSE round(v[1], 6) END AS pose FROM v WHERE vec_id % 5 <> 1)"


def poses(spark, sf):
    return vectors(spark, sf).where("vec_id % 5 <> 1").select("clip", "frame", F.when(F.col("vec_id") % 7 == 3, None).otherwise(F.round(F.col("v")[0], 6)).alias("pose"))


@query("pose_ffill", f"""WITH {POSES}, e AS (SELECT clip, unnest(range(0, max(frame) + 1)) AS frame FROM poses GROUP BY clip), j AS (SELECT e.clip, e.frame, p.frame IS NOT NULL AS present, CASE WHEN p.frame IS NOT NULL THEN coalesce(pose, -9999.0::DOUBLE) END AS value FROM e LEFT JOIN poses p ON p.clip = e.clip AND p.frame = e.frame)
SELECT clip, frame, present, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING), -9999.0::DOUBLE) AS pose FROM j""")
def pose_ffill(spark, sf):
    return L.pose_filled(poses(spark, sf))


@query("null_frames", f"WITH {POSES} SELECT clip, count(*) AS frames, count(pose) AS poses, count(*) - count(pose) AS null_frames FROM poses GROUP BY clip")
def null_frames(spark, sf):
    """A frame that can't be read is null and counts zero; the clip goes on."""
    raw = vectors(spark, sf).where("vec_id % 5 <> 1").select("clip", F.when(F.col("vec_id") % 7 == 3, F.lit("broken")).otherwise(F.col("v")[0].cast("string")).alias("raw"))
    read = raw.withColumn("pose", F.col("raw").try_cast("double"))
    return read.groupBy("clip").agg(F.count("*").alias("frames"), F.count("pose").alias("poses"), (F.count("*") - F.count("pose")).alias("null_frames"))


@query("ffill_limit", f"""WITH {V}, s AS (SELECT clip, frame, CASE WHEN vec_id % 11 < 3 THEN round(v[1], 6) END AS hand FROM v), m AS (SELECT *, last_value(hand IGNORE NULLS) OVER w AS held, frame - last_value(CASE WHEN hand IS NOT NULL THEN frame END IGNORE NULLS) OVER w AS misses FROM s WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT clip AS session_id, frame AS idx, CASE WHEN misses <= 5 THEN held ELSE 0 END AS hand FROM m""")
def ffill_limit(spark, sf):
    d = vectors(spark, sf).select(F.col("clip").alias("session_id"), F.col("frame").alias("idx"), F.when(F.col("vec_id") % 11 < 3, F.round(F.col("v")[0], 6)).alias("seen"))
    return O.filled_with_limit(d, "seen", "hand", 5).select("session_id", "idx", "hand")


@query("presence_stats", f"""WITH {V}, s AS (SELECT clip, frame, len(list_filter(v, lambda x: x > 0.1)) AS hands, len(list_filter(v, lambda x: x < -0.1)) AS faces FROM v)
SELECT clip, frame, CAST(max(hands) AS BIGINT) AS hands, CAST(max(faces) AS BIGINT) AS faces FROM s GROUP BY GROUPING SETS ((clip, frame), (clip))""")
def presence_stats(spark, sf):
    count = lambda f: F.coalesce(F.size(F.filter("v", f)), F.lit(0)).cast("long")
    s = vectors(spark, sf).select("clip", "frame", count(lambda x: x > 0.1).alias("hands"), count(lambda x: x < -0.1).alias("faces"))
    return s.groupingSets([[F.col("clip"), F.col("frame")], [F.col("clip")]], "clip", "frame").agg(F.max("hands").alias("hands"), F.max("faces").alias("faces"))


@query("hit_rate", f"WITH {V} SELECT clip, round(avg(CASE WHEN len(list_filter(v, lambda x: x > 0.3)) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hands, round(avg(CASE WHEN v[1] > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pose FROM v GROUP BY clip")
def hit_rate(spark, sf):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return vectors(spark, sf).groupBy("clip").agg(share(F.exists("v", lambda x: x > 0.3)).alias("hands"), share(F.col("v")[0] > 0).alias("pose"))


@query("detections_cap", f"WITH {V}, c AS (SELECT clip, frame, i - 1 AS cand, v[i] AS score FROM v, unnest(range(1, 9)) AS r(i)), k AS (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY cand) AS place FROM c WHERE score > -0.05) SELECT clip, frame, cand, round(score, 6) AS score FROM k WHERE place <= 3 AND score >= 0.05")
def detections_cap(spark, sf):
    """At most three candidates a frame; one below the confidence still takes its place."""
    c = vectors(spark, sf).select("clip", "frame", F.posexplode(F.slice("v", 1, 8)).alias("cand", "score")).where("score > -0.05")
    place = F.row_number().over(W.partitionBy("clip", "frame").orderBy("cand"))
    return c.withColumn("place", place).where("place <= 3 AND score >= 0.05").select("clip", "frame", F.col("cand").cast("long").alias("cand"), F.round("score", 6).alias("score"))


@query("hand_side", f"WITH {V}, c AS (SELECT clip, frame, i AS pos, CASE WHEN v[i] + 0.5 > 0.5 THEN 'right' ELSE 'left' END AS side, round(v[i + 8], 6) AS point FROM v, unnest(range(1, 4)) AS r(i)) SELECT clip, frame, side, arg_max(point, pos) AS point FROM c GROUP BY clip, frame, side")
def hand_side(spark, sf):
    """A later detection of a side replaces an earlier one."""
    c = vectors(spark, sf).select("clip", "frame", F.posexplode(F.slice("v", 1, 3)).alias("pos", "score"), F.slice("v", 9, 3).alias("pts"))
    side = F.when(F.col("score") + 0.5 > 0.5, "right").otherwise("left")
    return c.groupBy("clip", "frame", side.alias("side")).agg(F.max_by(F.round(F.get("pts", F.col("pos")), 6), "pos").alias("point"))


@query("pack_slots", f"""WITH {V}, s AS (SELECT clip, frame, CASE WHEN frame % 3 > 0 THEN p[1:4] ELSE list_transform(range(4), lambda i: [0.0::DOUBLE, 0.0]) END AS a, CASE WHEN frame % 4 > 0 THEN p[5:7] ELSE list_transform(range(3), lambda i: [0.0::DOUBLE, 0.0]) END AS b, p[8:9] AS c FROM pt)
SELECT clip, frame, list_transform(list_concat(list_concat(a, b), c), lambda q: round(q[1], 6)) AS xs FROM s""")
def pack_slots(spark, sf):
    """Parts in a fixed order of slots; zeros stand for a part that was not seen."""
    zeros = lambda n: F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), n)
    seen = lambda k, a, n: F.when(F.col("frame") % k > 0, F.slice("p", a, n))
    d = vectors(spark, sf).select("clip", "frame", F.concat(F.coalesce(seen(3, 1, 4), zeros(4)), F.coalesce(seen(4, 5, 3), zeros(3)), F.slice("p", 8, 2)).alias("slots"))
    return d.select("clip", "frame", F.transform("slots", lambda q: L.rounded(q[0], 6)).alias("xs"))


@query("layer_mix", f"WITH {V}, l AS (SELECT clip, i AS d, frame % 4 AS layer, CAST(floor(frame / 4) AS BIGINT) AS t, v[i + 1] AS x FROM v, unnest(range(0, 64)) AS r(i)) SELECT clip, t, d, round(sum(x * (layer + 1) / 10.0::DOUBLE), 6) AS mixed FROM l GROUP BY clip, t, d")
def layer_mix(spark, sf):
    """Weighted sum over layers; four consecutive vectors are the layers of a frame."""
    weights = F.broadcast(spark.createDataFrame([(i, (i + 1) / 10.0) for i in range(4)], "layer long, weight double"))  # one row per layer
    d = vectors(spark, sf).select("clip", (F.col("frame") % 4).alias("layer"), F.floor(F.col("frame") / 4).alias("t"), F.posexplode("v").alias("d", "x"))
    return d.join(weights, "layer").groupBy("clip", "t", F.col("d").cast("long").alias("d")).agg(F.round(F.sum(F.col("x") * F.col("weight")), 6).alias("mixed"))


@query("shoulder_norm", f"""WITH {V}, s AS (SELECT clip, avg((p[6][1] + p[7][1]) / 2) AS cx, avg((p[6][2] + p[7][2]) / 2) AS cy, avg(sqrt(pow(p[6][1] - p[7][1], 2) + pow(p[6][2] - p[7][2], 2))) AS scale FROM pt GROUP BY clip)
SELECT pt.clip, frame, round(CASE WHEN scale > 0 THEN (p[1][1] - cx) / scale ELSE p[1][1] END, 6) AS x, round(CASE WHEN scale > 0 THEN (p[1][2] - cy) / scale ELSE p[1][2] END, 6) AS y FROM pt JOIN s ON s.clip = pt.clip""")
def shoulder_norm(spark, sf):
    v = vectors(spark, sf)
    a, b = F.col("p")[5], F.col("p")[6]
    s = v.groupBy("clip").agg(F.avg((a[0] + b[0]) / 2).alias("cx"), F.avg((a[1] + b[1]) / 2).alias("cy"), F.avg(B.distance(a, b)).alias("scale"))
    norm = lambda i, c: F.round(F.when(F.col("scale") > 0, (F.col("p")[0][i] - F.col(c)) / F.col("scale")).otherwise(F.col("p")[0][i]), 6)
    return v.join(s, "clip").select("clip", "frame", norm(0, "cx").alias("x"), norm(1, "cy").alias("y"))


@query("pixel_metrics", f"""WITH {V}, px AS (SELECT clip, frame, list_transform(v, lambda x: CAST(floor(x * 100 + 128) AS DOUBLE)) AS px FROM v), b AS (SELECT clip, frame, px, lag(px) OVER (PARTITION BY clip ORDER BY frame) AS bx FROM px),
d AS (SELECT clip, frame, i AS pos, abs(px[i + 1] - bx[i + 1]) AS d FROM b, unnest(range(0, 64)) AS r(i) WHERE bx IS NOT NULL),
m AS (SELECT clip, frame, avg(d) AS mean, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.99) AS p99 FROM d GROUP BY clip, frame),
k AS (SELECT clip, frame, max(b) AS block FROM (SELECT clip, frame, (pos // 8) // 4 AS br, (pos % 8) // 4 AS bc, avg(d) AS b FROM d GROUP BY ALL) GROUP BY clip, frame)
SELECT d.clip, d.frame, round(mean, 6) AS current, round(med, 6) AS shift, round(100.0 * count(*) FILTER (WHERE d - med > 8) / count(*), 6) AS pct, round(block, 6) AS block, round(p99, 6) AS p99 FROM d JOIN m ON m.clip = d.clip AND m.frame = d.frame JOIN k ON k.clip = d.clip AND k.frame = d.frame GROUP BY ALL""")
def pixel_metrics(spark, sf):
    px = vectors(spark, sf).select("clip", "frame", F.transform("v", lambda x: F.floor(x * 100 + 128).cast("double")).alias("px"))
    return L.pixel_metrics(px, "clip", "frame", "px")


@query("embedding_spread", f"WITH {V}, l AS (SELECT clip, i, v[i] AS x FROM v, unnest(range(1, 65)) AS r(i)), s AS (SELECT clip, i, var_samp(x) AS var FROM l GROUP BY clip, i) SELECT clip, round(avg(sqrt(var + 1e-6)), 6) AS spread FROM s GROUP BY clip")
def embedding_spread(spark, sf):
    d = L.long_form(vectors(spark, sf), ["clip"], "v")
    return d.groupBy("clip", "pos").agg(F.var_samp("v").alias("var")).groupBy("clip").agg(F.round(F.avg(F.sqrt(F.col("var") + 1e-6)), 6).alias("spread"))


@query("resample_128", f"""WITH {V}, n AS (SELECT clip, max(frame) + 1 AS n FROM v GROUP BY clip),
s AS (SELECT clip, slot, CASE WHEN n > 128 THEN CAST(floor(slot * (n - 1) / 127.0::DOUBLE) AS BIGINT) ELSE slot END AS frame FROM n, unnest(range(0, 128)) AS r(slot)) SELECT s.clip, slot, coalesce(round(v[1], 6), 0.0::DOUBLE) AS x FROM s LEFT JOIN v f ON f.clip = s.clip AND f.frame = s.frame""")
def resample_128(spark, sf):
    return L.resampled(vectors(spark, sf).select("clip", "frame", F.round(F.col("v")[0], 6).alias("x")), "clip", "frame", "x")


@query("pad_batch", f"""WITH {V}, s AS (SELECT clip, frame // 8 AS part, flatten(list(list_transform(v, lambda x: round(x, 6)) ORDER BY frame)) AS xs FROM v GROUP BY clip, frame // 8), m AS (SELECT max(len(xs)) AS n FROM s)
SELECT clip, CAST(part AS BIGINT) AS part, list_concat(xs, list_transform(range(n - len(xs)), lambda i: 0.0::DOUBLE)) AS xs FROM s, m""")
def pad_batch(spark, sf):
    """Streams of a batch, vector after vector, padded with zeros to the longest (eight frames at most)."""
    d = vectors(spark, sf).groupBy("clip", F.floor(F.col("frame") / 8).alias("part")).agg(F.sort_array(F.collect_list(F.struct("frame", F.transform("v", lambda x: L.rounded(x, 6)).alias("x")))).alias("s")).withColumn("s", F.flatten("s.x"))
    most = F.broadcast(d.agg(F.max(F.size("s")).alias("n")))  # one row
    return d.join(most).select("clip", "part", F.concat("s", F.array_repeat(F.lit(0.0), (F.col("n") - F.size("s")).cast("int"))).alias("xs"))


PIX = "list_transform(p[{a}:{b}], lambda q: CAST(trunc((q[{i}] + 0.6) * {size}) AS INTEGER))"
HB = V + f""", q AS (SELECT clip, frame, list_transform(p[9:16], lambda q: [q[1] + 0.6, q[2] + 0.6]) AS p FROM pt),
x AS (SELECT clip, frame, list_transform(p, lambda q: CAST(trunc(q[1] * {W_}) AS INTEGER)) AS xs, list_transform(p, lambda q: CAST(trunc(q[2] * {H_}) AS INTEGER)) AS ys FROM q),
e AS (SELECT *, greatest(list_max(xs) - list_min(xs) + 1, list_max(ys) - list_min(ys) + 1) AS side, CAST(trunc(list_sum(xs)::DOUBLE / len(xs)) AS INTEGER) AS cx, CAST(trunc(list_sum(ys)::DOUBLE / len(ys)) AS INTEGER) AS cy FROM x),
r AS (SELECT clip, frame, cx, cy, xs, ys, side // 2 + CAST(trunc(side * 0.5 / 2) AS INTEGER) AS reach FROM e), hb AS (SELECT clip, frame, cx - reach AS x1, cy - reach AS y1, cx + reach AS x2, cy + reach AS y2, xs, ys FROM r)"""


def hand_points(spark, sf):
    return vectors(spark, sf).select("clip", "frame", F.transform(F.slice("p", 9, 8), lambda q: F.array(q[0] + 0.6, q[1] + 0.6)).alias("pts"))


def boxed(spark, sf):
    return hand_points(spark, sf).select("clip", "frame", B.square_box(F.col("pts"), W_, H_).alias("box"))


@query("hand_box", f"WITH {HB} SELECT clip, frame, x1, y1, x2, y2 FROM hb")
def hand_box(spark, sf):
    return boxed(spark, sf).select("clip", "frame", "box.*")


MOVED = HB + f""", m1 AS (SELECT clip, frame, x1 - greatest(x2 - {W_}, 0) AS x1, x2 - greatest(x2 - {W_}, 0) AS x2, y1 - greatest(y2 - {H_}, 0) AS y1, y2 - greatest(y2 - {H_}, 0) AS y2 FROM hb), bx AS (SELECT clip, frame, x1 + greatest(-x1, 0) AS x1, y1 + greatest(-y1, 0) AS y1, x2 + greatest(-x1, 0) AS x2, y2 + greatest(-y1, 0) AS y2 FROM m1)"""


@query("box_clamp", f"WITH {MOVED} SELECT * FROM bx")
def box_clamp(spark, sf):
    return boxed(spark, sf).select("clip", "frame", B.shifted_inside(F.col("box"), W_, H_).alias("box")).select("clip", "frame", "box.*")


@query("face_box", f"""WITH {HB}, b AS (SELECT clip, frame, list_min(xs) - 10 AS x1, list_max(xs) + 10 AS x2, list_min(ys) - 10 AS y1, list_max(ys) + 10 AS y2 FROM hb), m AS (SELECT *, greatest(((y2 - y1) - (x2 - x1)) // 2, 0) AS mx, greatest(((x2 - x1) - (y2 - y1)) // 2, 0) AS my FROM b)
SELECT clip, frame, greatest(0, least(x1 - mx, {W_})) AS x1, greatest(0, least(y1 - my, {H_})) AS y1, greatest(0, least(x2 + mx, {W_})) AS x2, greatest(0, least(y2 + my, {H_})) AS y2 FROM m""")
def face_box(spark, sf):
    return hand_points(spark, sf).select("clip", "frame", B.padded_square(F.col("pts"), W_, H_).alias("box")).select("clip", "frame", "box.*")


UNIT = "(CAST('0x' || left(md5('5:' || clip || ':' || frame || ':{0}'), 8) AS BIGINT)::DOUBLE / 4294967295.0 * 2 - 1)"


@query("box_jitter", f"""WITH {MOVED}, d AS (SELECT *, 1 + 0.1::DOUBLE * {UNIT.format('scale')} AS s, 8.0::DOUBLE * {UNIT.format('x')} AS dx, 8.0::DOUBLE * {UNIT.format('y')} AS dy FROM bx),
a AS (SELECT clip, frame, greatest(0, least(CAST(round_even((x1 + x2) / 2.0::DOUBLE - (x2 - x1) / 2.0::DOUBLE * s + dx, 0) AS INTEGER), {W_ - 1})) AS x1, least(CAST(round_even((x1 + x2) / 2.0::DOUBLE + (x2 - x1) / 2.0::DOUBLE * s + dx, 0) AS INTEGER), {W_}) AS x2,
  greatest(0, least(CAST(round_even((y1 + y2) / 2.0::DOUBLE - (y2 - y1) / 2.0::DOUBLE * s + dy, 0) AS INTEGER), {H_ - 1})) AS y1, least(CAST(round_even((y1 + y2) / 2.0::DOUBLE + (y2 - y1) / 2.0::DOUBLE * s + dy, 0) AS INTEGER), {H_}) AS y2 FROM d)
SELECT clip, frame, x1, y1, greatest(x2, x1 + 1) AS x2, greatest(y2, y1 + 1) AS y2 FROM a""")
def box_jitter(spark, sf):
    inside = boxed(spark, sf).select("clip", "frame", B.shifted_inside(F.col("box"), W_, H_).alias("box"))
    return inside.select("clip", "frame", B.jittered(F.col("box"), 5, F.col("clip"), F.col("frame"), 0.1, 8.0, W_, H_).alias("box")).select("clip", "frame", "box.*")


@query("box_ffill", f"WITH {HB}, s AS (SELECT clip, frame, CASE WHEN frame % 4 = 1 THEN x1 END AS b FROM hb) SELECT clip, frame, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS x1 FROM s")
def box_ffill(spark, sf):
    """The last good box of a part; zero while there was none."""
    d = boxed(spark, sf).withColumn("seen", F.when(F.col("frame") % 4 == 1, F.col("box")))
    return d.select("clip", "frame", F.coalesce(O.filled("seen", ["clip"], ["frame"])["x1"], F.lit(0)).alias("x1"))


@query("signing_space", f"""WITH {V}, s AS (SELECT clip, frame, p, nullif(sqrt(pow(p[12][1] - p[13][1], 2) + pow(p[12][2] - p[13][2], 2)) / 2, 0) AS head FROM pt)
SELECT clip, frame, round((p[5][1] - (p[1][1] - 3 * head)) / (6 * head) - 0.5, 6) AS x, round((p[5][2] - (p[3][2] - head / 2)) / (7 * head) - 0.5, 6) AS y FROM s""")
def signing_space(spark, sf):
    p = F.col("p")
    d = vectors(spark, sf).select("clip", "frame", B.signing_space(p, p[11], p[12], p[2], p[0]).alias("s"))
    return d.select("clip", "frame", F.round(F.col("s")[4][0], 6).alias("x"), F.round(F.col("s")[4][1], 6).alias("y"))


@query("align_streams", f"""WITH {V}, a AS (SELECT clip, frame, round(v[1], 6) AS face FROM v), b AS (SELECT clip, frame, round(v[2], 6) AS lft FROM v WHERE vec_id % 9 <> 4), c AS (SELECT clip, frame, round(v[3], 6) AS rgt FROM v), d AS (SELECT clip, frame, round(v[4], 6) AS pose FROM v)
SELECT a.clip, a.frame - 3 AS frame, face, lft AS left_hand, rgt AS right_hand, pose FROM a JOIN b USING (clip, frame) JOIN c USING (clip, frame) JOIN d USING (clip, frame) WHERE a.frame >= 3""")
def align_streams(spark, sf):
    """Four streams by clip and frame, dealt by that key once, then a slice, from the fourth frame to the end, counted from zero again."""
    v = vectors(spark, sf).where("frame >= 3")
    stream = lambda i, n: v.select("clip", "frame", F.round(F.col("v")[i], 6).alias(n))
    lft = v.where("vec_id % 9 <> 4").select("clip", "frame", F.round(F.col("v")[1], 6).alias("left_hand"))
    on = ["clip", "frame"]
    return stream(0, "face").join(lft, on).join(stream(2, "right_hand"), on).join(stream(3, "pose"), on).withColumn("frame", F.col("frame") - 3)


@query("topk_labels", f"""WITH {V}, l AS (SELECT vec_id, i - 1 AS cls, v[i] * 10 AS x FROM v, unnest(range(1, 65)) AS r(i)), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM l), s AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, cls) AS rank FROM e),
names AS (SELECT n_nationkey AS k, n_name AS name FROM nation) SELECT vec_id, rank, name || ' ' || cls // 25 AS name, round(p, 6) AS p FROM s JOIN names ON k = cls % 25 WHERE rank <= 5""")
def topk_labels(spark, sf):
    """Softmax over all 64 classes and the five best by name; names of nations, numbered where they come again."""
    d = vectors(spark, sf).select("vec_id", F.posexplode(F.transform("v", lambda x: x * 10)).alias("cls", "x"))
    w = W.partitionBy("vec_id")
    e = d.withColumn("e", F.exp(F.col("x") - F.max("x").over(w)))
    p = e.withColumns({"p": F.col("e") / F.sum("e").over(w), "rank": F.row_number().over(w.orderBy(F.desc("x"), "cls"))}).where("rank <= 5")
    names = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))  # 25 rows
    named = F.concat_ws(" ", "n", F.floor(F.col("cls") / 25).cast("string")).alias("name")
    return p.join(names, F.col("cls") % 25 == F.col("k")).select("vec_id", F.col("rank").cast("long").alias("rank"), named, F.round("p", 6).alias("p"))
