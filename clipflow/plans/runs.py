"""Queries of manifests, ledgers, run comparison and bookkeeping over ``documents``, ``orders``, ``lineitem`` and others."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.functions import text as X
from clipflow.operators import manifest as A
from clipflow.plans.registry import query
from clipflow.plans.tables import CLIPS, clips, table
from clipflow.sources import ledger as L
from clipflow.sources.shared import shared_dir

MAN = CLIPS + """, man AS (SELECT 'd' || id AS id, id AS position, category, reference, hyp_a, hyp_b FROM clips), led AS (SELECT id, hyp_a AS hypothesis FROM man WHERE position % 3 <> 0)"""


def manifest(spark, sf):
    c = clips(spark, sf)
    return c.select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.col("id").alias("position"), "category", "reference", "hyp_a", "hyp_b")


def ledger(m):
    return m.where("position % 3 <> 0").select("id", F.col("hyp_a").alias("hypothesis"))


@query("remaining", f"WITH {MAN} SELECT id, position FROM man WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.id = man.id)")
def remaining(spark, sf):
    m = manifest(spark, sf)
    return A.remaining(m, ledger(m)).select("id", "position")


@query("ordered_outputs", f"WITH {MAN} SELECT man.id, man.position, hypothesis FROM man JOIN led ON led.id = man.id")
def ordered_outputs(spark, sf):
    m = manifest(spark, sf)
    return A.ordered_outputs(m, ledger(m)).orderBy("position")


TWO = MAN + """, ra AS (SELECT id, reference, hyp_a AS hypothesis FROM man WHERE position % 5 <> 0), rb AS (SELECT id, CASE WHEN position % 97 = 1 THEN reference || ' !' ELSE reference END AS reference, hyp_b AS hypothesis FROM man WHERE position % 7 <> 0)"""


def two_runs(spark, sf):
    m = manifest(spark, sf)
    b = m.where("position % 7 <> 0").select("id", F.when(F.col("position") % 97 == 1, F.concat("reference", F.lit(" !"))).otherwise(F.col("reference")).alias("reference"), F.col("hyp_b").alias("hypothesis"))
    return m.where("position % 5 <> 0").select("id", "reference", F.col("hyp_a").alias("hypothesis")), b


@query("pair_runs", f"WITH {TWO} SELECT ra.id, ra.hypothesis = rb.hypothesis AS same FROM ra JOIN rb ON ra.id = rb.id")
def pair_runs(spark, sf):
    return A.pairs(*two_runs(spark, sf)).select("id", (F.col("hypothesis_a") == F.col("hypothesis_b")).alias("same"))


@query("ref_mismatch", f"WITH {TWO} SELECT ra.id, ra.reference AS reference_a, rb.reference AS reference_b FROM ra JOIN rb ON ra.id = rb.id WHERE ra.reference <> rb.reference")
def ref_mismatch(spark, sf):
    return A.mismatches(A.pairs(*two_runs(spark, sf)))


CONFIG = """ca AS (SELECT user_id // 2 AS pair, event_type || ':' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) AS key, CAST(count(*) AS VARCHAR) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2), cb AS (SELECT user_id // 2 AS pair, event_type || ':' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) AS key, CAST(count(*) AS VARCHAR) AS value FROM events WHERE user_id % 2 = 1 GROUP BY 1, 2)"""


def configs(spark, sf):
    """Pairs of open configurations, keys and values from the events of users 2 n and 2 n + 1: two tables with the pair, key and value."""
    key = F.concat_ws(":", "event_type", (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    of = lambda u: table(spark, sf, "events").where(F.col("user_id") % 2 == u).groupBy(F.floor(F.col("user_id") / 2).alias("pair"), key.alias("key")).agg(F.count("*").cast("string").alias("value"))
    return of(0), of(1)


@query("config_diff", f"WITH {CONFIG} SELECT pair, key, coalesce(ca.value, '<not recorded>') AS a, coalesce(cb.value, '<not recorded>') AS b FROM ca FULL JOIN cb USING (pair, key) WHERE coalesce(ca.value, '<not recorded>') <> coalesce(cb.value, '<not recorded>')")
def config_diff(spark, sf):
    return A.config_diff(*configs(spark, sf), by=("pair",))


@query("repair_guard", f"WITH {CONFIG} SELECT pair, key, ca.value AS saved, cb.value AS wanted FROM ca JOIN cb USING (pair, key) WHERE ca.value <> cb.value")
def repair_guard(spark, sf):
    return A.repair_guard(*configs(spark, sf), by=("pair",))


#: Configurations of which some pairs agree: whether the clicks and views of a user are odd in number.
SETTINGS = """sa AS (SELECT user_id // 2 AS pair, event_type AS key, CAST(count(*) % 2 AS VARCHAR) AS value FROM events WHERE user_id % 2 = 0 AND event_type IN ('click', 'view') GROUP BY 1, 2), sb AS (SELECT user_id // 2 AS pair, event_type AS key, CAST(count(*) % 2 AS VARCHAR) AS value FROM events WHERE user_id % 2 = 1 AND event_type IN ('click', 'view') GROUP BY 1, 2)"""
#: Runs that the manifest is dealt over; each has the configuration pair of its number.
RUNS = 75


@query("resume_plan", f"""WITH {MAN}, {SETTINGS}, bad AS (SELECT DISTINCT pair FROM sa FULL JOIN sb USING (pair, key) WHERE sa.value IS DISTINCT FROM sb.value)
SELECT man.id, CASE WHEN bad.pair IS NOT NULL THEN 'refused' ELSE 'run' END AS action FROM man LEFT JOIN bad ON bad.pair = man.position % {RUNS} WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.id = man.id)""")
def resume_plan(spark, sf):
    """What is left to run, and whether its run's configuration still allows it. The ledger is read from its files: two batches, one
    committed twice, and a last line that was cut short, so that its clip runs again."""
    m, path = manifest(spark, sf), shared_dir(spark, "ledger")
    done = ledger(m).withColumn("part", F.xxhash64("id") % 2)
    for batch, part in ((0, "part = 0"), (1, "part <> 0"), (1, "part <> 0")):
        L.commit(done.where(part).select("id", "hypothesis"), batch, path)
    torn = m.where("position % 3 = 0").agg(F.max("id").alias("id")).select(F.format_string('{"id":"%s","hypothesis":"cut sh', "id").alias("value"))
    torn.coalesce(1).write.text(f"{path}/batch=torn")
    of = lambda u: table(spark, sf, "events").where((F.col("user_id") % 2 == u) & F.col("event_type").isin("click", "view")).groupBy(F.floor(F.col("user_id") / 2).alias("pair"), F.col("event_type").alias("key")).agg((F.count("*") % 2).cast("string").alias("value"))
    bad = A.config_diff(of(0), of(1), by=("pair",)).select("pair").distinct()
    left = A.remaining(m, L.read(spark, path, "id string, hypothesis string")).select("id", (F.col("position") % RUNS).alias("pair"))
    return left.join(bad.withColumn("bad", F.lit(True)), "pair", "left").select("id", F.when(F.col("bad"), "refused").otherwise("run").alias("action"))


@query("repair_merge", f"WITH {MAN}, o AS (SELECT id, position, CASE WHEN position % 10 = 0 THEN '  ' ELSE hyp_a END AS hypothesis FROM man), x AS (SELECT id, hyp_b AS h FROM man WHERE position % 20 = 0) SELECT o.id, CASE WHEN trim(hypothesis) = '' AND x.id IS NOT NULL THEN h ELSE hypothesis END AS hypothesis, trim(hypothesis) = '' AND x.id IS NOT NULL AS patched FROM o LEFT JOIN x ON x.id = o.id")
def repair_merge(spark, sf):
    m = manifest(spark, sf)
    outputs = m.select("id", F.when(F.col("position") % 10 == 0, "  ").otherwise(F.col("hyp_a")).alias("hypothesis"))
    return A.repaired(outputs, m.where("position % 20 = 0").select("id", F.col("hyp_b").alias("hypothesis")))


@query("skip_done", "WITH i AS (SELECT doc_id, 'in/' || source || '/v' || doc_id || '.mp4' AS path, 'v' || doc_id AS stem FROM documents) SELECT path, stem FROM i WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 0")
def skip_done(spark, sf):
    n = F.col("doc_id").cast("string")
    path = F.concat(F.lit("in/"), F.col("source"), F.lit("/v"), n, F.lit(".mp4"))
    i = table(spark, sf, "documents").select("doc_id", path.alias("path"), X.path_stem(path).alias("stem"))
    return A.not_done(i.select("path", "stem"), i.where("doc_id % 4 = 0"), i.where("doc_id % 9 = 0"))


@query("basename_join", f"WITH {MAN}, f AS (SELECT 'clips/' || category || '/' || id || '.mp4' AS file, reference FROM man), q AS (SELECT '/elsewhere/' || id || '.mp4' AS file FROM man WHERE position % 2 = 0) SELECT q.file, f.reference FROM q JOIN f ON regexp_extract(q.file, '[^/]+$') = regexp_extract(f.file, '[^/]+$')")
def basename_join(spark, sf):
    m = manifest(spark, sf)
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    f = m.select(base(F.concat(F.lit("clips/"), F.col("category"), F.lit("/"), F.col("id"), F.lit(".mp4"))).alias("base"), "reference")
    q = m.where("position % 2 = 0").select(F.concat(F.lit("/elsewhere/"), F.col("id"), F.lit(".mp4")).alias("file"))
    return q.withColumn("base", base("file")).join(f, "base").select("file", "reference")


HMS = "printf('%02d:%02d:%06.3f', o_orderkey // 3600 % 24, o_orderkey // 60 % 60, o_orderkey % 60 + 0.25)"


@query("hhmmss", f"WITH s AS (SELECT o_orderkey AS id, {HMS} AS hms FROM orders) SELECT id, hms, CAST(split_part(hms, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(hms, ':', 2) AS DOUBLE) * 60 + CAST(split_part(hms, ':', 3) AS DOUBLE) AS seconds FROM s")
def hhmmss(spark, sf):
    k = F.col("o_orderkey")
    hms = F.format_string("%02d:%02d:%06.3f", F.floor(k / 3600) % 24, F.floor(k / 60) % 60, (k % 60).cast("double") + 0.25)
    return table(spark, sf, "orders").select(k.alias("id"), hms.alias("hms")).withColumn("seconds", X.hhmmss_seconds("hms"))


@query("path_parts", r"SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS stem, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '_[^_]*$', '') AS name FROM pages")
def path_parts(spark, sf):
    stem = X.path_stem("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("base"), stem.alias("stem"), F.regexp_replace(stem, "_[^_]*$", "").alias("name"))


@query("stage_totals", "WITH s AS (SELECT l_returnflag || CASE WHEN l_linestatus = 'O' THEN '_overlapped' ELSE '' END AS stage, l_suppkey % 3 AS detector, l_quantity AS sec FROM lineitem) SELECT CAST(detector AS BIGINT) AS detector, round(sum(sec) FILTER (WHERE NOT ends_with(stage, '_overlapped')), 2) AS critical, round(sum(sec), 2) AS total, round(avg(sec) * 1000, 4) AS ms FROM s GROUP BY detector")
def stage_totals(spark, sf):
    stage = F.concat("l_returnflag", F.when(F.col("l_linestatus") == "O", "_overlapped").otherwise(""))
    s = table(spark, sf, "lineitem").select(stage.alias("stage"), (F.col("l_suppkey") % 3).cast("long").alias("detector"), F.col("l_quantity").alias("sec"))
    own = F.when(~F.endswith("stage", F.lit("_overlapped")), F.col("sec"))
    return s.groupBy("detector").agg(F.round(F.sum(own), 2).alias("critical"), F.round(F.sum("sec"), 2).alias("total"), F.round(F.avg("sec") * 1000, 4).alias("ms"))


@query("run_summary", "SELECT o_orderpriority AS run, count(*) AS clips, count(*) FILTER (WHERE o_orderstatus = 'F') AS failures, count(*) FILTER (WHERE o_orderstatus = 'P') AS deferred, round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS mean_seconds FROM orders GROUP BY 1")
def run_summary(spark, sf):
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.count("*").alias("clips"), F.count_if(failed).alias("failures"), F.count_if(F.col("o_orderstatus") == "P").alias("deferred"), F.round(F.avg(F.when(~failed, F.col("o_totalprice"))), 2).alias("mean_seconds")
    )


@query("ab_summary", f"WITH {CLIPS}, t AS (SELECT category, hyp_a = hyp_b AS same, length(reference) AS wa, length(hyp_b) AS wb FROM clips) SELECT category, count(*) AS clips, count(*) FILTER (WHERE same) AS identical, round(avg(wa - wb), 6) AS mean_delta, round(avg(100.0::DOUBLE * (wa - wb) / nullif(wa, 0)), 6) AS mean_reduction_pct FROM t GROUP BY category")
def ab_summary(spark, sf):
    t = clips(spark, sf).select("category", F.col("hyp_a").eqNullSafe(F.col("hyp_b")).alias("same"), F.length("reference").alias("wa"), F.length("hyp_b").alias("wb"))
    saved = F.col("wa") - F.col("wb")
    return t.groupBy("category").agg(F.count("*").alias("clips"), F.count_if("same").alias("identical"), F.round(F.avg(saved), 6).alias("mean_delta"), F.round(F.avg(F.try_divide(100.0 * saved, "wa")), 6).alias("mean_reduction_pct"))


@query("gloss_index", "WITH d AS (SELECT DISTINCT trim(upper(source)) AS label FROM documents) SELECT label, row_number() OVER (ORDER BY label) - 1 AS ix FROM d WHERE label <> ''")
def gloss_index(spark, sf):
    return A.vocabulary(table(spark, sf, "documents").select(F.concat(F.lit(" "), F.upper("source")).alias("gloss")), "gloss")


ANN = """ann AS (SELECT doc_id AS first, source AS yid, printf('%02d:%02d:%06.3f', doc_id // 3600 % 24, doc_id // 60 % 60, doc_id % 60 + 0.0) AS start, doc_id % 86400 AS start_s, doc_id % 86400 + n_chars / 1000.0::DOUBLE AS end_s FROM documents)"""


def annotations(spark, sf):
    k = F.col("doc_id")
    hms = F.format_string("%02d:%02d:%06.3f", F.floor(k / 3600) % 24, F.floor(k / 60) % 60, (k % 60).cast("double"))
    return table(spark, sf, "documents").select(k.alias("first"), F.col("source").alias("yid"), hms.alias("start"), (k % 86400).alias("start_s"), (k % 86400 + F.col("n_chars") / 1000.0).alias("end_s"))


@query("subset_build", f"""WITH {ANN}, s AS (SELECT yid, count(*) AS n, min(first) AS first FROM ann GROUP BY yid), t AS (SELECT yid, row_number() OVER (ORDER BY n DESC, first) AS rank FROM s WHERE length(yid) <> 5),
d AS (SELECT ann.*, rank, row_number() OVER (PARTITION BY ann.yid ORDER BY start, ann.first) AS i FROM ann JOIN t ON t.yid = ann.yid WHERE rank <= 6)
SELECT yid || '_' || CASE WHEN i < 10 THEN '0' || i ELSE CAST(i AS VARCHAR) END AS id, yid, round(end_s - start_s, 2) AS seconds FROM d WHERE end_s - start_s >= 0.8::DOUBLE ORDER BY rank, i LIMIT 60""")
def subset_build(spark, sf):
    """The limits on videos and clips are what the operator is for."""
    return A.subset(annotations(spark, sf), F.length("yid") != 5)


@query("transcript", "SELECT conv_id, turn, substr('Signer: ' || text, 9) AS said FROM conversations WHERE role = 'assistant'")
def transcript(spark, sf):
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("Signer: "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").withColumn("line", line).where(F.startswith("line", F.lit("Signer: "))).select("conv_id", "turn", F.expr("substring(line, 9)").alias("said"))
