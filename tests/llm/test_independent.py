"""Operators whose results SQL can't express against plain versions, and tables whose columns have the names that operators use."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipflow.llm import bpe, decontaminate, license_scans, quality_classifier, quality_rules, secret_scans, sharding, simhash, url_filters, warc
from clipflow.llm.textstats import doc_stats


def test_em_by_documents(spark, sf):
    """EM over single documents, not over counts of patterns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = quality_rules.judge(docs).collect()
    names = [f"vote_{r.name}" for r in quality_rules.RULES]
    votes = [[r[n] for n in names] for r in got]
    right, share = {(c, j): p for c, p in ((0, 0.3), (1, 0.98)) for j in range(len(names))}, 0.85
    post = [share] * len(votes)
    for _ in range(3000):
        before = post
        post = []
        for v in votes:
            logs = []
            for c, s in ((0, 1 - share), (1, share)):
                logs.append(math.log(s) + sum(math.log(right[c, j] if (x == 1) == (c == 1) else 1 - right[c, j]) for j, x in enumerate(v) if x))
            post.append(1 / (1 + math.exp(min(max(logs[0] - logs[1], -500), 500))))
        if max(abs(a - b) for a, b in zip(post, before, strict=True)) <= 1e-10:
            break
        for j in range(len(names)):
            good = sum(p for p, v in zip(post, votes, strict=True) if v[j] == 1), sum(1 - p for p, v in zip(post, votes, strict=True) if v[j] == 1)
            bad = sum(p for p, v in zip(post, votes, strict=True) if v[j] == -1), sum(1 - p for p, v in zip(post, votes, strict=True) if v[j] == -1)
            right[1, j] = (98 + good[0]) / (100 + good[0] + bad[0])
            right[0, j] = (3 + bad[1]) / (10 + good[1] + bad[1])
        share = min(max((sum(post) + 8.5) / (len(post) + 10), 0.02), 0.98)
    assert all(abs(r.p_good - p) < 1e-6 and r.kept == (not r.base_failed and p >= 0.5) for r, p in zip(got, post, strict=True))


def test_em_says_when_it_has_not_settled():
    patterns, counts = np.array([[1, 1, -1], [1, -1, 0], [-1, -1, 1]]), np.array([5, 3, 2])
    with pytest.warns(UserWarning, match="not settled"):
        quality_rules.fit_votes(patterns, counts, rounds=2)


def plain_classifier(docs, labels):
    """The same model from the definitions, in one place: mean, spread, features, ridge, pooled calibration."""
    q = quality_classifier
    x = {i: q.features([doc_stats(t)])[0] for i, t in docs}
    every = np.array([x[i] for i, _ in docs])
    mean, spread = every.mean(0), every.std(0)
    spread = np.where(spread == 0, 1.0, spread)
    rng = np.random.default_rng(7)
    weights, shift = rng.normal(0, 1 / np.sqrt(q.N_STATS), (q.N_STATS, q.N_FEATURES)), rng.uniform(0, 2 * np.pi, q.N_FEATURES)

    def mapped(v):
        z = np.clip((v - mean) / spread, -6, 6)
        return np.append(np.sqrt(2 / q.N_FEATURES) * np.cos(z @ weights + shift), 1.0)

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    z, y = (np.array(v, float) for v in zip(*((mapped(x[i]), lab) for i, lab in labels if fold(i) >= 2), strict=True))
    ridge = np.linalg.solve(z.T @ z + q.RIDGE * np.sqrt(len(z)) * np.eye(q.N_FEATURES + 1), z.T @ y)
    n, ones = Counter(), Counter()
    for i, lab in labels:
        if fold(i) == 1:
            b = int(np.clip(np.floor((mapped(x[i]) @ ridge + 0.5) * q.BINS / 2), 0, q.BINS))
            n[b] += 1
            ones[b] += lab
    at = sorted(n)
    # isotonic by the greatest lower bound of upper means
    level = [max(min(sum(ones[b] for b in at[i : k + 1]) / sum(n[b] for b in at[i : k + 1]) for k in range(j, len(at))) for i in range(j + 1)) for j in range(len(at))]
    edges = [(b + 0.5) * 2 / q.BINS - 0.5 for b in at]
    return {i: float(np.interp(mapped(x[i]) @ ridge, edges, level)) for i, _ in docs}


def test_op10_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None]
    want = plain_classifier(docs, [(i, lab) for i, lab in labels if i in dict(docs)])
    got = {r.doc_id: r.score for r in quality_classifier.query(spark, sf).collect()}
    assert len(got) == len(docs) and max(abs(got[i] - want[i]) for i in got) < 1e-5


def test_packing_takes_the_highest_dot_product():
    rng = np.random.default_rng(3)
    demand, shards = rng.integers(1, 1000, (400, 3)).astype(float), 7
    placed, need = sharding.pack(demand, shards), demand / demand.sum(0)
    left = [[1 / shards] * 3 for _ in range(shards)]
    for i in sorted(range(len(need)), key=lambda i: (-max(need[i]), i)):
        fits = [s for s in range(shards) if all(left[s][k] >= need[i][k] for k in range(3))]
        value = lambda s: sum(left[s][k] * need[i][k] for k in range(3))
        over = lambda s: max(max(need[i][k] - left[s][k], 0) for k in range(3))
        best = max(map(value, fits)) if fits else min(map(over, range(shards)))
        assert (placed[i] in fits and abs(value(placed[i]) - best) < 1e-12) if fits else abs(over(placed[i]) - best) < 1e-12
        for k in range(3):
            left[placed[i]][k] -= need[i][k]


def test_rows_repeated_under_one_id_are_dealt(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "one text for all " * 30) for i in range(800)] + [(i, f"other {i} " * 60) for i in range(800)], "doc_id long, text string").repartition(4)
    got = sharding.slotted(sharding.assign(docs, 8), 1600).collect()
    sums = Counter(r.shard for r in got)
    assert len(got) == 1600 and max(sums.values()) < 1.15 * 200
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sums.items())


def test_joins_that_disagree_are_widened(monkeypatch):
    """With stray tokens at made places the ids stay those of the whole text, whatever is repaired."""
    import public_tokenizers

    e, rng = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    monkeypatch.setattr(bpe, "MEAN_BITS", 5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "an other ", "<|endoftext|>", "it's ", " \n ", "ß ", "x", "42 ", "a b c d "]) for _ in range(rng.randint(1, 120)))
        assert e(text).tolist() == e.vocabulary.encode(text.encode()).tolist()
    honest, calls = e.vocabulary.encode, Counter()

    def stray(piece):
        calls["n"] += 1
        ids = honest(piece)
        return np.append(ids[:-1], ids[-1:] + 1) if len(piece) < 12 and calls["n"] % 7 == 0 else ids

    text = " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(400))
    e.store.clear()
    for chunk in bpe.chunks(text.encode()):  # cores with wrong words at their ends: their joins can't agree
        core = e.core(chunk)
        if core is not None and rng.random() < 0.4:
            head, ids, first, first_ids, last, last_ids, tail = core
            e.store[chunk] = head, ids, first, first_ids + np.uint32(rng.random() < 0.5), last, last_ids + np.uint32(rng.random() < 0.5), tail
    before = e.repaired
    assert e(text).tolist() == honest(text.encode()).tolist() and e.repaired > before
    assert stray(b"x") is not None


CLASHES = (
    "n_words word_chars n_symbols n_lines kept p_good base_failed count vote_length score x fold y held_out hits items ids fp content component_id root first rows shard slot key piece bundle s0 s1 s2 dealt start block "
    "n_hit ranges host path rule ruling verdict u __block code base spans n_network place windows value label apart t row __text __name __least __ways __way part licenses matches digest last kind n e blocks"
).split()


@pytest.fixture(scope="module")
def clashing(spark, documents):
    rows = [(i, t, None if t is None else len(t), *(["own"] * len(CLASHES))) for i, t in documents]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def own(df, *without):
    return [c for c in CLASHES if c in df.columns and c not in without]


def test_every_function_on_clashing_names(spark, edge, clashing, documents):
    n = len(documents)
    labels, bench = spark.read.parquet(f"{edge}/labels.parquet"), spark.read.parquet(f"{edge}/benchmark.parquet")
    judged = quality_rules.judge(clashing)
    assert judged.count() == n and dict(judged.dtypes)["p_good"] == "double" and len(set(judged.columns)) == len(judged.columns)
    kept = quality_classifier.keep(clashing, labels)
    assert kept.schema == clashing.schema and {r.score for r in kept.collect()} <= {"own"}
    one = simhash.deduplicate(clashing)
    assert one.columns == clashing.columns and {r.fp for r in one.collect()} == {"own"}
    clean = decontaminate.clean(clashing, bench)
    assert clean.columns == clashing.columns and {r.hits for r in clean.collect()} == {"own"}
    safe = secret_scans.redact(clashing)
    assert safe.columns == clashing.columns and safe.count() == n and {r.spans for r in safe.collect()} == {"own"}
    path = bpe.vocabulary_path()
    back = bpe.decode(bpe.encode(clashing, path), path)
    assert Counter((r.doc_id, r.text or "") for r in back.collect()) == Counter((i, t or "") for i, t in documents) and {r.score for r in back.collect()} == {"own"}
    assert license_scans.scan(clashing).count() == n == simhash.near_duplicates(clashing).count()
    assert sharding.slotted(sharding.assign(clashing, 8), n).count() == n
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.substring("text", 1, 9)).alias("url"), F.col("text").alias("html"), *own(clashing))
    assert url_filters.judge(pages).count() == n
    out = f"{edge}/clashing"
    warc.write(pages, f"file://{out}")
    assert warc.read_archives(spark, f"file://{out}").count() == n
