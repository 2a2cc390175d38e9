"""Queries of sources and sinks: tables are written in a file format of the data model and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.functions import sql as U
from clipflow.operators import textmetrics as M
from clipflow.plans.landmarks import V, vectors
from clipflow.plans.registry import query
from clipflow.plans.runs import ANN, MAN, annotations, manifest
from clipflow.plans.segmentation import SEGMENTS, clips
from clipflow.plans.tables import CLIPS, FRAMES, frames, table
from clipflow.plans.text import bleu_sql, chrf_sql, stats_sql, summed
from clipflow.sources import readers as R
from clipflow.sources import ledger as L
from clipflow.sources import sinks as K
from clipflow.sources.shared import shared_dir


@query("read_frames", f"WITH {FRAMES} SELECT session_id, idx, t, phase, score, present FROM frames")
def read_frames(spark, sf):
    path = shared_dir(spark, "frames")
    frames(spark, sf).select("session_id", "idx", "t", "phase", "score", "present").write.json(path)
    return R.read_frames(spark, path)


@query("manifest_latest", f"WITH {MAN} SELECT id, CASE WHEN position % 3 = 0 THEN 'second' ELSE category END AS category, reference FROM man")
def manifest_latest(spark, sf):
    """Every third record is written twice; the later line counts."""
    path = shared_dir(spark, "manifest")
    m = manifest(spark, sf).select(F.col("position").alias("line"), "id", "category", "reference")
    again = m.where("line % 3 = 0").withColumns({"line": F.col("line") + 1_000_000_000, "category": F.lit("second")})
    m.union(again).write.json(path)
    return R.read_manifest(spark, path).select("id", "category", "reference")


def saved_runs(spark, sf):
    """A run per language, saved as nested JSON."""
    path = shared_dir(spark, "runs")
    m = manifest(spark, sf)
    outputs = m.select(F.col("category").alias("run"), "id", "category", "reference", F.col("hyp_b").alias("hypothesis"), (F.length("hyp_b") / 10).alias("seconds"))
    config = m.groupBy(F.col("category").alias("run")).agg(F.count("*").cast("string").alias("n")).select("run", F.create_map(F.lit("clips"), "n", F.lit("beam"), F.lit("4")).alias("config"))
    K.write_runs(outputs, config, path)
    return path


@query("runs_explode", f"WITH {MAN}, c AS (SELECT category, CAST(count(*) AS VARCHAR) AS clips FROM man GROUP BY category) SELECT m.category AS run, id, hyp_b AS hypothesis, length(hyp_b) / 10::DOUBLE AS seconds, clips, '4' AS beam FROM man m JOIN c ON c.category = m.category")
def runs_explode(spark, sf):
    outputs, config = R.read_runs(spark, saved_runs(spark, sf))
    return outputs.join(config, "run").select("run", "id", "hypothesis", "seconds", F.col("config")["clips"].alias("clips"), F.col("config")["beam"].alias("beam"))


@query("rescore", f"WITH {CLIPS}, r AS (SELECT 'd' || id AS id, category, hyp_b AS hyp, reference AS ref FROM clips), {stats_sql('r', 'id, category')}, b AS (SELECT category, count(*) AS clips, round({bleu_sql(summed())}, 4) AS bleu FROM bleu_stats GROUP BY category), c AS (SELECT category, round({chrf_sql(summed())}, 4) AS chrf FROM chrf_stats GROUP BY category) SELECT category AS run, clips, bleu, chrf FROM b JOIN c USING (category)")
def rescore(spark, sf):
    """Metrics made anew from a saved run's outputs and written as a new version beside it."""
    outputs, _ = R.read_runs(spark, saved_runs(spark, sf))
    b, c = M.bleu_stats(outputs, ["run", "id"], "hypothesis", "reference"), M.chrf_stats(outputs, ["run", "id"], "hypothesis", "reference")
    bleu = b.groupBy("run").agg(*(F.sum(n).alias(n) for n in M.BLEU), F.count("*").alias("clips")).select("run", "clips", F.round(M.bleu(), 4).alias("bleu"))
    scores = bleu.join(c.groupBy("run").agg(*(F.sum(n).alias(n) for n in M.CHRF)).select("run", F.round(M.chrf(), 4).alias("chrf")), "run")
    path = shared_dir(spark, "rescored")
    scores.write.json(path)
    return spark.read.schema(scores.schema).json(path)


@query("annotations_split", f"WITH {ANN} SELECT yid, start, CAST(first AS VARCHAR) AS raw_text FROM ann WHERE first % 4 = 1")
def annotations_split(spark, sf):
    path = shared_dir(spark, "annotations")
    split = F.when(F.col("first") % 4 == 1, "test").otherwise("train")
    rows = annotations(spark, sf).select("yid", "start", F.col("start").alias("end"), F.col("first").cast("string").alias("raw_text"), split.alias("split"))
    rows.write.csv(path, sep="\t", header=True)
    return R.read_annotations(spark, path, "test").select("yid", "start", "raw_text")


@query("prompts", "WITH p AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN '# note' WHEN n_nationkey % 7 = 0 THEN '' ELSE lower(n_name) || chr(9) || 'It is ' || n_name || '.' END AS line FROM nation), q AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM p WHERE contains(line, chr(9))) SELECT printf('%03d', i) AS id, split_part(line, chr(9), 1) AS category, split_part(line, chr(9), 2) AS sentence FROM q")
def prompts(spark, sf):
    """A prompt file of one line per nation, with comments and blank lines."""
    path, k = shared_dir(spark, "prompts"), F.col("n_nationkey")
    line = F.when(k % 6 == 0, "# note").when(k % 7 == 0, "").otherwise(F.concat(F.lower("n_name"), F.lit("\tIt is "), "n_name", F.lit(".")))
    table(spark, sf, "nation").select(k, line.alias("value")).coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    return R.read_prompts(spark, path)


@query("label_table", "SELECT DISTINCT trim(n_name) AS gloss FROM nation")
def label_table(spark, sf):
    path = shared_dir(spark, "labels")
    table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.concat("n_name", F.lit(" ")).alias("gloss")).write.csv(path, header=True)
    return R.read_glosses(spark, path).distinct()


@query("stream_paths", "SELECT 'face/' || vec_id AS face, 'left/' || vec_id AS left_hand, 'right/' || vec_id AS right_hand, 'pose/' || vec_id AS pose FROM embeddings")
def stream_paths(spark, sf):
    path = shared_dir(spark, "paths")
    of = lambda p: F.concat(F.lit(p), F.col("vec_id").cast("string"))
    table(spark, sf, "embeddings").select(F.concat_ws("\t", *map(of, ("face/", "left/", "right/", "pose/"))).alias("first"), F.lit("x").alias("rest")).write.csv(path)
    return R.read_stream_paths(spark, path)


@query("landmarks_explode", f"WITH {V} SELECT clip, CAST(frame AS INTEGER) AS frame, CASE WHEN frame % 5 = 0 THEN NULL ELSE round(v[1], 6) END AS x, CASE WHEN frame % 5 = 0 THEN 0 ELSE 2 END AS points FROM v")
def landmarks_explode(spark, sf):
    """Landmark documents, one per clip, with null frames."""
    path = shared_dir(spark, "landmarks")
    xy = F.array(F.array(F.round(F.col("v")[0], 6), F.lit(0.0), F.lit(0.0)), F.array(F.round(F.col("v")[1], 6), F.lit(0.0), F.lit(0.0)))
    mark = F.when(F.col("frame") % 5 != 0, F.struct(F.array(xy).alias("face_landmarks"), F.lit(None).cast("array<array<array<double>>>").alias("hand_landmarks"), F.array(xy).alias("pose_landmarks")))
    d = vectors(spark, sf).select("clip", F.struct(F.col("frame").cast("string").alias("k"), mark.alias("v")).alias("e"))
    d.groupBy("clip").agg(F.map_from_entries(F.collect_list("e")).alias("frames")).write.json(path, ignoreNullFields=False)
    pose = F.col("landmarks.pose_landmarks")[0]
    return R.read_landmarks(spark, path).select("clip", "frame", pose[0][0].alias("x"), F.coalesce(F.size(pose), F.lit(0)).alias("points"))


@query("sink_landmarks", f"WITH {V} SELECT clip, count(*) AS frames, round(max(v[1]), 6) AS most FROM v GROUP BY clip")
def sink_landmarks(spark, sf):
    path = shared_dir(spark, "marks")
    K.write_landmarks(vectors(spark, sf).select("clip", "frame", F.round(F.col("v")[0], 6).alias("x")), path)
    return spark.read.schema("frame long, x double, clip long").parquet(path).groupBy("clip").agg(F.count("*").alias("frames"), F.max("x").alias("most"))


@query("list_files", "SELECT CAST(count(DISTINCT label) AS BIGINT) AS clips FROM embeddings")
def list_files(spark, sf):
    """Folders of the partitioned sink that hold files, by listing."""
    path = shared_dir(spark, "listed")
    K.write_landmarks(vectors(spark, sf).select("clip", "frame"), path)
    return R.list_files(spark, path, "*.parquet").where("length > 0").select(F.regexp_extract("path", "clip=([0-9]+)", 1).alias("c")).agg(F.countDistinct("c").alias("clips"))


PROF = FRAMES + ", pr AS (SELECT session_id, CASE WHEN session_id % 4 = 1 THEN 0 WHEN session_id % 4 = 2 THEN NULL ELSE max(score) END AS start_threshold, min(score) AS stop_threshold FROM frames GROUP BY session_id)"


def profiles(spark, sf):
    path, s = shared_dir(spark, "profiles"), F.col("session_id")
    f = frames(spark, sf)
    peaks = f.groupBy("session_id", "phase").agg(F.array(F.max("score"), F.min("score")).alias("v")).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "v"))).alias("phase_peaks"))  # one entry per phase
    p = f.groupBy("session_id").agg(F.max("score").alias("m"), F.min("score").alias("stop_threshold")).select("session_id", F.when(s % 4 == 1, 0.0).when(s % 4 != 2, F.col("m")).alias("start_threshold"), "stop_threshold")
    p.join(peaks, "session_id").write.json(path, ignoreNullFields=False)
    return path


@query("profile_load", f"WITH {PROF} SELECT session_id, start_threshold, stop_threshold FROM pr WHERE start_threshold <> 0")
def profile_load(spark, sf):
    return R.read_profile(spark, profiles(spark, sf)).select("session_id", "start_threshold", "stop_threshold")


@query("sink_profile", f"WITH {FRAMES} SELECT session_id, phase, max(score) AS peak FROM frames WHERE session_id % 4 NOT IN (1, 2) GROUP BY ALL")
def sink_profile(spark, sf):
    """The nested map of a profile survives the file."""
    return R.read_profile(spark, profiles(spark, sf)).select("session_id", F.explode("phase_peaks").alias("phase", "v")).select("session_id", "phase", F.col("v")[0].alias("peak"))


@query("sink_manifest", f"WITH {MAN} SELECT id, category, reference FROM man")
def sink_manifest(spark, sf):
    path = shared_dir(spark, "sorted")
    K.write_jsonl(manifest(spark, sf).select("id", "category", "reference"), path, "id")
    return spark.read.schema("id string, category string, reference string").json(path)


@query("ledger_append", f"WITH {SEGMENTS} SELECT session_id || ':' || start_idx AS id, session_id, start_idx FROM clips")
def ledger_append(spark, sf):
    """Finished records of a stream, a file a batch, into the ledger; the second batch is committed twice more."""
    path, source, c = shared_dir(spark, "ledger"), shared_dir(spark, "finished"), clips(spark, sf)
    records = c.select(F.concat_ws(":", "session_id", "start_idx").alias("id"), "session_id", "start_idx")
    for part in range(3):
        records.where(f"session_id % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
    L.stream(spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(source), path, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    again = spark.read.schema("value string").text(f"{path}/batch=0000000001").select(F.from_json("value", "id string, session_id long, start_idx long").alias("r")).select("r.*")
    L.commit(again, 3, path)  # the same records under another number: the last of an id counts once
    return L.read(spark, path, "id string, session_id long, start_idx long")


@query("sql_functions", "SELECT c_custkey AS id, round(CASE WHEN c_mktsegment = upper(n_name) THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(c_mktsegment, upper(n_name)) / greatest(length(c_mktsegment), length(n_name))::DOUBLE END, 6) AS similarity FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sql_functions(spark, sf):
    U.register(spark, "clipflow_")
    c, n = table(spark, sf, "customer"), F.broadcast(table(spark, sf, "nation"))  # 25 rows
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("c_custkey").alias("id"), F.expr("round(clipflow_char_similarity(c_mktsegment, upper(n_name)), 6)").alias("similarity"))
