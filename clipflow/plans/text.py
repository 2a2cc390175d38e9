"""Queries of text functions, corpus metrics and run comparison over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipflow.functions import text as X
from clipflow.operators import compare as C
from clipflow.operators import textmetrics as M
from clipflow.plans.registry import query
from clipflow.plans.tables import CLIPS, clips, table

#: The reference's default.
RESAMPLES = 2000


def nouns_sql(x: str) -> str:
    return f"""(SELECT coalesce(list(w ORDER BY i), []) FROM (SELECT lower(x) AS w, min(i) AS i FROM (SELECT unnest(regexp_extract_all({x}, '[A-Za-z'']+')) AS x, unnest(range(len(regexp_extract_all({x}, '[A-Za-z'']+')))) AS i) WHERE i > 0 AND regexp_matches(x, '^[A-Z][a-z]*$') GROUP BY lower(x)))"""


NUMBER_MAP = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in X.NUMBERS.items()) + "}"


def numbers_sql(x: str) -> str:
    """A lateral expression: the text with numbers normalised."""
    t = rf"""regexp_extract_all(lower(regexp_replace({x}, '\$\s*(\d+)', '\1 dollars', 'g')), '[A-Za-z'']+|\d+|[^\sA-Za-z\d'']')"""
    d = f"list_transform({t}, lambda w: coalesce({NUMBER_MAP}[w], w))"
    join = "coalesce(regexp_matches(d[{0}], '^[0-9]+$') AND TRY_CAST(d[{0}] AS BIGINT) % 10 = 0 AND TRY_CAST(d[{0}] AS BIGINT) BETWEEN 20 AND 90 AND regexp_matches(d[{0} + 1], '^[0-9]+$') AND TRY_CAST(d[{0} + 1] AS BIGINT) BETWEEN 1 AND 9, false)"
    return f"""(SELECT trim(replace(regexp_replace(coalesce(array_to_string(list_transform(list_filter(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN {join.format('i')} THEN CAST(TRY_CAST(d[i] AS BIGINT) + TRY_CAST(d[i + 1] AS BIGINT) AS VARCHAR) WHEN i > 1 AND {join.format('(i - 1)')} THEN NULL ELSE d[i] END), lambda w: w IS NOT NULL), lambda w: ' ' || w || ' '), ''), ''), ' ([0-9]+) (?: (?:st|nd|rd|th) )+', ' \\1 ', 'g'), '  ', ' ')) FROM (SELECT {d} AS d))"""


def tokens_sql(x: str) -> str:
    s = f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    s = f"' ' || {s} || ' '"
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    return rf"list_filter(string_split(trim(regexp_replace({s}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def similarity_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"


@query("proper_nouns", f"WITH {CLIPS} SELECT id, array_to_string({nouns_sql('reference')}, ' ') AS nouns FROM clips")
def proper_nouns(spark, sf):
    return clips(spark, sf).select("id", F.array_join(X.proper_nouns("reference"), " ").alias("nouns"))


SAMPLE = "(reference || ' twenty one 10th $5 thirty 3 forty-five ' || id || ' st')"


@query("normalize_numbers", f"WITH {CLIPS}, s AS (SELECT id, {SAMPLE} AS x FROM clips) SELECT id, {numbers_sql('x')} AS text FROM s")
def normalize_numbers(spark, sf):
    x = F.concat("reference", F.lit(" twenty one 10th $5 thirty 3 forty-five "), F.col("id").cast("string"), F.lit(" st"))
    return clips(spark, sf).select("id", X.normalized_numbers(x).alias("text"))


@query("char_similarity", f"WITH p AS (SELECT c_custkey AS id, lower(c_mktsegment) AS a, lower(n_name) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, round({similarity_sql('a', 'b')}, 6) AS similarity FROM p")
def char_similarity(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation"))  # 25 rows
    p = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return p.select(F.col("c_custkey").alias("id"), F.round(X.char_similarity(F.lower("c_mktsegment"), F.lower("n_name")), 6).alias("similarity"))


def runs_sql(name: str, keys: str, parts: str, orders: int, glue: str) -> str:
    """CTEs that end in ``name``: n, g and how often each side has it. Runs are made from neighbours by ``lead``: cutting them out of a long text would take its square."""
    each = ", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(1, orders))
    run = lambda n: f" || '{glue}' || ".join(["c", *(f"c{k}" for k in range(1, n))])
    there = lambda n: f" WHERE c{n - 1} IS NOT NULL" if n > 1 else ""
    sides = " UNION ALL ".join(f"SELECT {keys}, {side == 'h'} AS own, unnest({side}{parts}) AS c, generate_subscripts({side}{parts}, 1) AS i FROM tok" for side in "hr")
    orders_ = " UNION ALL ".join(f"SELECT {keys}, {n} AS n, {run(n)} AS g, own FROM {name}_ld{there(n)}" for n in range(1, orders + 1))
    return f"""{name}_ld AS MATERIALIZED (SELECT {keys}, own, c, {each} FROM ({sides}) WINDOW w AS (PARTITION BY {keys}, own ORDER BY i)),
{name} AS (SELECT {keys}, n, g, count(*) FILTER (WHERE own) AS h, count(*) FILTER (WHERE NOT own) AS r FROM ({orders_}) GROUP BY ALL)"""


def stats_sql(source: str, keys: str, hyp: str = "hyp", ref: str = "ref") -> str:
    """CTEs bleu_stats and chrf_stats of a relation with the keys, hyp and ref."""
    ms = ", ".join(f"CAST(coalesce(sum(least(h, r)) FILTER (WHERE n = {n}), 0) AS BIGINT) AS m{n}, CAST(coalesce(sum(h) FILTER (WHERE n = {n}), 0) AS BIGINT) AS t{n}, CAST(coalesce(sum(r) FILTER (WHERE n = {n}), 0) AS BIGINT) AS u{n}" for n in range(1, 5))
    cs = ", ".join(f"CAST(coalesce(sum(least(h, r)) FILTER (WHERE n = {n}), 0) AS BIGINT) AS cm{n}, CAST(coalesce(sum(h) FILTER (WHERE n = {n}), 0) AS BIGINT) AS ch{n}, CAST(coalesce(sum(r) FILTER (WHERE n = {n}), 0) AS BIGINT) AS cr{n}" for n in range(1, 7))
    chars = lambda c: f"string_split(regexp_replace({c}, '\\s+', '', 'g'), '')"
    return f"""tok AS MATERIALIZED (SELECT {keys}, {tokens_sql(hyp)} AS ht, {tokens_sql(ref)} AS rt, {chars(hyp)} AS hc, {chars(ref)} AS rc FROM {source}),
{runs_sql("g", keys, "t", 4, " ")},
bs AS (SELECT {keys}, {ms} FROM g GROUP BY ALL),
bleu_stats AS (SELECT tok.* EXCLUDE (ht, rt, hc, rc), {", ".join(f"coalesce({k}{n}, 0) AS {k}{n}" for k in "mt" for n in range(1, 5))}, coalesce(t1, 0) AS hyp_len, coalesce(u1, 0) AS ref_len FROM tok LEFT JOIN bs USING ({keys})),
{runs_sql("cg", keys, "c", 6, "")},
ccs AS (SELECT {keys}, {cs} FROM cg GROUP BY ALL),
chrf_stats AS (SELECT tok.* EXCLUDE (ht, rt, hc, rc), {", ".join(f"coalesce({k}{n}, 0) AS {k}{n}" for k in ("cm", "ch", "cr") for n in range(1, 7))} FROM tok LEFT JOIN ccs USING ({keys}))"""


def bleu_sql(get=lambda c: c, effective: bool = False) -> str:
    m, t = ([get(f"{k}{n}") for n in range(1, 5)] for k in "mt")
    zero = [f"(CASE WHEN {m[n]} = 0 AND {t[n]} > 0 THEN 1 ELSE 0 END)" for n in range(4)]
    logs = [f"(CASE WHEN {t[n]} > 0 THEN ln(CASE WHEN {m[n]} > 0 THEN 100.0::DOUBLE * {m[n]} / {t[n]} ELSE 100.0::DOUBLE / (pow(2.0, {' + '.join(zero[: n + 1])}) * {t[n]}) END) ELSE 0 END)" for n in range(4)]
    orders = " + ".join(f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in t)
    bp = f"CASE WHEN {get('hyp_len')} >= {get('ref_len')} THEN 1.0::DOUBLE ELSE exp(1 - {get('ref_len')}::DOUBLE / {get('hyp_len')}) END"
    return f"CASE WHEN {' + '.join(m)} = 0 OR {t[0 if effective else 3]} = 0 THEN 0.0::DOUBLE ELSE ({bp}) * exp(({' + '.join(logs)}) / ({orders})) END"


def chrf_sql(get=lambda c: c) -> str:
    both = [f"{get(f'ch{n}')} > 0 AND {get(f'cr{n}')} > 0" for n in range(1, 7)]
    n_both = "(" + " + ".join(f"(CASE WHEN {b} THEN 1 ELSE 0 END)" for b in both) + ")"
    p, q = ("((" + " + ".join(f"(CASE WHEN {both[n - 1]} THEN {get(f'cm{n}')}::DOUBLE / {get(f'{k}{n}')} ELSE 0 END)" for n in range(1, 7)) + f") / nullif({n_both}, 0))" for k in ("ch", "cr"))
    return f"coalesce(100.0::DOUBLE * 5.0 * {p} * {q} / nullif(4.0 * {p} + {q}, 0), 0)"


VARIANTS = CLIPS + f""", variants AS (SELECT id, category, 'raw' AS kind, hyp_a AS hyp, reference AS ref FROM clips UNION ALL SELECT id, category, 'numbers', {numbers_sql('hyp_a')}, {numbers_sql('reference')} FROM clips)"""


def variants(spark, sf, hyp="hyp_a"):
    """Each clip twice: to be scored as it is and with its numbers normalised."""
    c = clips(spark, sf)
    both = F.array(F.struct(F.lit("raw").alias("kind"), F.col(hyp).alias("hyp"), F.col("reference").alias("ref")), F.struct(F.lit("numbers").alias("kind"), F.col(hyp).alias("hyp"), F.col("reference").alias("ref")))
    return c.select("id", "category", F.inline(both))


def scored(spark, sf, hyp="hyp_a"):
    """Per category and overall (ALL): clips, bleu_raw, bleu and chrf."""
    stats = M.all_stats(variants(spark, sf, hyp), ["category", "kind"], "hyp", "ref", chars=F.col("kind") == "numbers", numbers=F.col("kind") == "numbers")
    sets = stats.groupingSets([[F.col("kind")], [F.col("category"), F.col("kind")]], "category", "kind")
    sums = sets.agg(F.grouping("category").alias("all"), F.count("*").alias("clips"), *(F.sum(n).alias(n) for n in M.BLEU + M.CHRF))
    each = sums.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("category")).alias("category"), "kind", "clips", F.round(M.bleu(), 4).alias("b"), F.round(M.chrf(), 4).alias("c"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return each.groupBy("category").agg(F.max("clips").alias("clips"), of("raw", "b").alias("bleu_raw"), of("numbers", "b").alias("bleu"), of("numbers", "c").alias("chrf"))


def summed(get="sum({0})"):
    return lambda c: get.format(c)


@query("corpus_scores", f"""WITH {VARIANTS}, {stats_sql('variants', 'id, category, kind')},
b AS (SELECT coalesce(category, 'ALL') AS category, kind, count(*) AS clips, round({bleu_sql(summed())}, 4) AS bleu FROM bleu_stats GROUP BY GROUPING SETS ((kind), (category, kind))),
c AS (SELECT coalesce(category, 'ALL') AS category, round({chrf_sql(summed())}, 4) AS chrf FROM chrf_stats WHERE kind = 'numbers' GROUP BY GROUPING SETS ((), (category)))
SELECT r.category, r.clips, r.bleu AS bleu_raw, n.bleu, c.chrf FROM b r JOIN b n ON n.category = r.category AND r.kind = 'raw' AND n.kind = 'numbers' JOIN c ON c.category = r.category""")
def corpus_scores(spark, sf):
    return scored(spark, sf)


@query("compare_runs", f"""WITH {CLIPS}, ab AS (SELECT id, category, run, CASE run WHEN 'a' THEN hyp_a ELSE hyp_b END AS hyp, reference AS ref FROM clips, (VALUES ('a'), ('b')) AS t(run)), {stats_sql('ab', 'id, category, run')},
b AS (SELECT coalesce(category, 'ALL') AS category, run, round({bleu_sql(summed())}, 4) AS bleu FROM bleu_stats GROUP BY GROUPING SETS ((run), (category, run))),
c AS (SELECT coalesce(category, 'ALL') AS category, run, round({chrf_sql(summed())}, 4) AS chrf FROM chrf_stats GROUP BY GROUPING SETS ((run), (category, run))),
m AS (SELECT category, run, 'bleu_raw' AS metric, bleu AS v FROM b UNION ALL SELECT category, run, 'chrf', chrf FROM c)
SELECT x.category, x.metric, x.v AS a, y.v AS b, round(y.v - x.v, 4) AS delta FROM m x JOIN m y ON y.category = x.category AND y.metric = x.metric AND x.run = 'a' AND y.run = 'b'""")
def compare_runs(spark, sf):
    return C.compared(runs_long(spark, sf))


def runs_long(spark, sf):
    """id, category, run (a, b), hyp, ref."""
    both = F.array(*(F.struct(F.lit(r).alias("run"), F.col(f"hyp_{r}").alias("hyp")) for r in "ab"))
    return clips(spark, sf).select("id", "category", F.col("reference").alias("ref"), F.inline(both))


@query("sentence_bleu", f"WITH {CLIPS}, v AS (SELECT id, hyp_a AS hyp, reference AS ref FROM clips), {stats_sql('v', 'id')} SELECT id, round({bleu_sql(effective=True)}, 4) AS bleu FROM bleu_stats")
def sentence_bleu(spark, sf):
    s = M.bleu_stats(clips(spark, sf), ["id"], "hyp_a", "reference")
    return s.select("id", F.round(M.bleu(effective=True), 4).alias("bleu"))


BEST = f"list_transform(nouns, lambda w: coalesce(list_max(list_transform(tokens, lambda g: {similarity_sql('w', 'g')})), 0.0::DOUBLE))"


def noun_rows(spark, sf, tokens):
    c = clips(spark, sf).select("id", "category", X.proper_nouns("reference").alias("nouns"), tokens.alias("tokens"))
    return c.select("id", "category", F.explode(F.arrays_zip("nouns", M.best_similarity(F.col("nouns"), F.col("tokens")).alias("best"))).alias("z")).select("id", "category", F.col("z.nouns").alias("noun"), F.round(F.col("z.best"), 6).alias("best"))


NOUNS = CLIPS + f""", n AS (SELECT id, category, {nouns_sql('reference')} AS nouns, regexp_extract_all(lower(hyp_a), '[A-Za-z'']+') AS tokens FROM clips),
nb AS (SELECT id, category, unnest(nouns) AS noun, round(unnest({BEST}), 6) AS best FROM n)"""


@query("noun_recall", f"WITH {NOUNS} SELECT category, count(*) AS nouns, round(100.0 * count(*) FILTER (WHERE best = 1) / count(*), 4) AS exact_pct, round(100.0 * count(*) FILTER (WHERE best >= 0.6) / count(*), 4) AS near_pct, round(100 * avg(best), 4) AS mean_similarity FROM nb GROUP BY category")
def noun_recall(spark, sf):
    n = noun_rows(spark, sf, X.letters(F.lower("hyp_a")))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return n.groupBy("category").agg(F.count("*").alias("nouns"), share(F.col("best") == 1).alias("exact_pct"), share(F.col("best") >= 0.6).alias("near_pct"), F.round(100 * F.avg("best"), 4).alias("mean_similarity"))


@query("noun_detail", f"WITH {NOUNS} SELECT id, noun, best FROM nb WHERE best < 1 ORDER BY id, noun LIMIT 14")
def noun_detail(spark, sf):
    """The first 14 nouns that are not exact: a report's length, not a sample."""
    return noun_rows(spark, sf, X.letters(F.lower("hyp_a"))).where("best < 1").orderBy("id", "noun").limit(14).select("id", "noun", "best")


@query("noun_similarity", f"""WITH {CLIPS}, n AS (SELECT id, category, {nouns_sql('reference')} AS nouns, list_filter(string_split(replace(replace(lower(hyp_a), ',', ' '), '.', ' '), ' '), lambda w: w <> '' AND regexp_matches(w, '^[ -~]*$')) AS tokens FROM clips),
nb AS (SELECT id, unnest({BEST}) AS best FROM n) SELECT count(*) AS nouns, round(100 * avg(best), 4) AS mean_similarity FROM nb""")
def noun_similarity(spark, sf):
    tokens = F.filter(F.split(F.translate(F.lower("hyp_a"), ",.", "  "), " "), lambda w: (w != "") & w.rlike("^[ -~]*$"))
    n = noun_rows(spark, sf, tokens)
    return n.agg(F.count("*").alias("nouns"), F.round(100 * F.avg("best"), 4).alias("mean_similarity"))


@query("degenerate_text", f"""WITH {CLIPS}, t AS (SELECT id, category, string_split(lower(hyp_a), ' ') AS w, len(string_split(hyp_a, ' ')) AS hw, len(string_split(reference, ' ')) AS rw, strlen(hyp_a) AS bytes FROM clips),
r AS (SELECT *, EXISTS (SELECT 1 FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g) GROUP BY g HAVING count(*) > 1) AS rep FROM t)
SELECT category, round(100 * avg(CASE WHEN rep THEN 1.0::DOUBLE ELSE 0 END), 4) AS repeated_pct, round(sum(hw)::DOUBLE / sum(rw), 6) AS word_ratio, quantile_cont(bytes, 0.5) AS bytes_p50, round(quantile_cont(bytes, 0.99), 4) AS bytes_p99, round(quantile_cont(bytes, 0.999), 4) AS bytes_p999 FROM r GROUP BY category""")
def degenerate_text(spark, sf):
    g = M.grams(F.split(F.lower("hyp_a"), " "), 3)
    t = clips(spark, sf).select("category", (F.size(F.array_distinct(g)) < F.size(g)).alias("rep"), F.size(F.split("hyp_a", " ")).alias("hw"), F.size(F.split("reference", " ")).alias("rw"), F.octet_length("hyp_a").alias("bytes"))
    p = F.percentile("bytes", F.array(F.lit(0.5), F.lit(0.99), F.lit(0.999)))
    out = t.groupBy("category").agg(F.round(100 * F.avg(F.when(F.col("rep"), 1.0).otherwise(0.0)), 4).alias("repeated_pct"), F.round(F.sum("hw") / F.sum("rw"), 6).alias("word_ratio"), p.alias("p"))
    return out.select("category", "repeated_pct", "word_ratio", F.col("p")[0].alias("bytes_p50"), F.round(F.col("p")[1], 4).alias("bytes_p99"), F.round(F.col("p")[2], 4).alias("bytes_p999"))


SB = CLIPS + f""", ab AS (SELECT id, run, CASE run WHEN 'a' THEN hyp_a ELSE hyp_b END AS hyp, reference AS ref FROM clips, (VALUES ('a'), ('b')) AS t(run)), {stats_sql('ab', 'id, run')},
sb AS (SELECT id, run, round({bleu_sql(effective=True)}, 6) AS s FROM bleu_stats),
gains AS (SELECT c.id, round(y.s - x.s, 4) AS gain FROM clips c JOIN sb x ON x.id = c.id AND x.run = 'a' JOIN sb y ON y.id = c.id AND y.run = 'b' WHERE c.hyp_a <> c.hyp_b)"""


def gains(spark, sf):
    """id and gain in sentence BLEU from a to b, for the clips whose text changed."""
    return C.gains(runs_long(spark, sf))


@query("change_counts", f"WITH {SB} SELECT (SELECT count(*) FROM clips) AS clips, count(*) AS changed, count(*) FILTER (WHERE gain > 0) AS better, count(*) FILTER (WHERE gain < 0) AS worse, count(*) FILTER (WHERE gain = 0) AS even FROM gains")
def change_counts(spark, sf):
    n = F.lit(clips(spark, sf).count())
    return gains(spark, sf).agg(n.alias("clips"), F.count("*").alias("changed"), *(F.count_if(c).alias(k) for k, c in (("better", F.col("gain") > 0), ("worse", F.col("gain") < 0), ("even", F.col("gain") == 0))))


@query("top_gains", f"WITH {SB} (SELECT 'gain' AS side, id, gain FROM gains ORDER BY gain DESC, id DESC LIMIT 5) UNION ALL (SELECT 'loss', id, gain FROM gains ORDER BY gain, id LIMIT 5)")
def top_gains(spark, sf):
    """The five best and the five worst changes: the report's length."""
    g = gains(spark, sf)
    best, worst = g.orderBy(F.desc("gain"), F.desc("id")).limit(5), g.orderBy("gain", "id").limit(5)
    return best.select(F.lit("gain").alias("side"), "id", "gain").union(worst.select(F.lit("loss").alias("side"), "id", "gain"))


@query("leave_winners_out", f"""WITH {SB}, rk AS (SELECT id, row_number() OVER (ORDER BY gain DESC, id DESC) AS rank FROM gains), k AS (SELECT unnest([1, 2, 5]) AS drop_n),
s AS (SELECT drop_n, run, {bleu_sql(summed())} AS b FROM bleu_stats CROSS JOIN k LEFT JOIN rk ON rk.id = bleu_stats.id WHERE rank IS NULL OR rank > drop_n GROUP BY drop_n, run)
SELECT CAST(x.drop_n AS BIGINT) AS drop_n, round(y.b - x.b, 4) AS delta FROM s x JOIN s y ON y.drop_n = x.drop_n AND x.run = 'a' AND y.run = 'b' WHERE x.drop_n <= (SELECT count(*) FROM gains)""")
def leave_winners_out(spark, sf):
    return C.without_winners(runs_long(spark, sf))


MIXED = "0 + key + r * {step} + 7".format(step=C.STEP)
for shift, factor in C.ROUNDS:
    MIXED = f"(xor(({MIXED}) % 4294967296, (({MIXED}) % 4294967296) >> {shift}) * {factor})"
TIMES = " + ".join(f"CAST(x >= {t} AS INTEGER)" for t in C.POISSON)


@query("paired_bootstrap", f"""WITH {CLIPS}, ab AS (SELECT id, run, CASE run WHEN 'a' THEN hyp_a ELSE hyp_b END AS h, reference AS rf FROM clips, (VALUES ('a'), ('b')) AS t(run)),
kinds AS (SELECT id, run, 'raw' AS kind, h AS hyp, rf AS ref FROM ab UNION ALL SELECT id, run, 'numbers', {numbers_sql('h')}, {numbers_sql('rf')} FROM ab), {stats_sql('kinds', 'id, run, kind')},
keys AS (SELECT id, CAST('0x' || left(md5(CAST(id AS VARCHAR)), 8) AS BIGINT) AS key FROM clips),
mixed AS (SELECT id, r, ({MIXED}) % 4294967296 AS x FROM keys, unnest(range({RESAMPLES})) AS a(r)),
draws AS (SELECT id, r, {TIMES} AS w FROM mixed UNION ALL SELECT id, -1, 1 FROM keys),
s AS (SELECT r, run, kind, {bleu_sql(lambda c: f"sum({c} * w)")} AS b FROM draws JOIN bleu_stats USING (id) WHERE w > 0 GROUP BY r, run, kind),
c AS (SELECT r, run, {chrf_sql(lambda c: f"sum({c} * w)")} AS b FROM draws JOIN chrf_stats USING (id) WHERE w > 0 AND kind = 'numbers' GROUP BY r, run),
m AS (SELECT r, run, CASE kind WHEN 'raw' THEN 'bleu_raw' ELSE 'bleu' END AS metric, b FROM s UNION ALL SELECT r, run, 'chrf', b FROM c),
d AS (SELECT x.metric, x.r, round(y.b - x.b, 6) AS d FROM m x JOIN m y ON y.r = x.r AND y.metric = x.metric AND x.run = 'a' AND y.run = 'b'),
l AS (SELECT metric, max(d) FILTER (WHERE r < 0) AS delta, list(d ORDER BY d) FILTER (WHERE r >= 0) AS l FROM d GROUP BY metric)
SELECT metric, round(delta, 4) AS delta, round(l[CAST(floor(0.025 * len(l)) AS INTEGER) + 1], 4) AS ci_low, round(l[CAST(floor(0.975 * len(l)) AS INTEGER) + 1], 4) AS ci_high, len(list_filter(l, lambda x: x <= 0))::DOUBLE / len(l) AS p_le_0 FROM l""")
def paired_bootstrap(spark, sf):
    return C.paired_bootstrap(runs_long(spark, sf), RESAMPLES)
