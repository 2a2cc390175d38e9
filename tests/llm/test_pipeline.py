"""The pipeline's stages against brute-force versions, on the edge table and on the smallest given one."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from test_contracts import norm, rows, run

import corpus_pipeline as P
from clipflow.llm import decontaminate, simhash


@pytest.fixture(params=["edge", "sf"])
def path(request):
    return request.getfixturevalue(request.param)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_copies(texts):
    """For each text the least position in its component of pairs with a Jaccard similarity of 0.8 or more, over all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for y in range(len(texts)):
        for x in range(y):
            a, b = sorted((len(sets[x]), len(sets[y])))
            if root[x] != root[y] and a >= 0.8 * b and (c := len(sets[x] & sets[y])) >= 0.8 * (a + b - c):
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("edits, same", [(1, True), (2, True), (4, False)])
def test_near_copies(spark, edits, same):
    """Texts of 100 words with some replaced: 5-word similarities of 0.90, 0.81 and 0.65. All of the first two go, none of the last."""
    base = [[f"w{g}x{i * 7919 % 1009}" for i in range(100)] for g in range(40)]
    change = lambda words, k: [f"new{k}{i}" if i in range(10, 10 + 10 * k, 10) else w for i, w in enumerate(words)]
    rows = [(g, " ".join(b)) for g, b in enumerate(base)] + [(100 + g, " ".join(change(b, edits))) for g, b in enumerate(base)]
    alike = lambda x, y: len(x & y) / len(x | y)
    assert (alike(shingles(rows[0][1]), shingles(rows[40][1])) >= 0.8) == same
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(40)) <= kept
    assert len(kept) == (40 if same else 80)


def test_bands_at_the_threshold():
    """Of pairs with a similarity of 0.80 to 0.83 hardly any share no band, whatever else is in the table."""
    rng, met, n = np.random.default_rng(1), 0, 2000
    for k in range(n):
        size = int(rng.integers(60, 600))
        shared = -int(-2 * size * 0.8 // 1.8)
        both = rng.integers(0, 1 << 63, 2 * size, dtype=np.int64)
        x, y = both[:size], both[size - shared : 2 * size - shared]
        assert 0.8 <= shared / (2 * size - shared) < 0.83
        met += bool(set(simhash.bands(x).tolist()) & set(simhash.bands(y).tolist()))
    assert met >= 0.997 * n


def test_crowded_cells_lose_no_pair(spark, monkeypatch):
    """Groups of near copies that share a cell with other groups: found across the cell's groups, in blocks."""
    monkeypatch.setattr(simhash, "CROWDED", 2)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    common = [f"c{i}" for i in range(120)]
    texts = []
    for g in range(12):  # half the words common to all: alike, but not near copies
        base = common + [f"g{g}w{i}" for i in range(120)]
        texts += [" ".join(base), " ".join([*base[:230], *(f"v{g}x{i}" for i in range(10))]), " ".join([*(f"u{g}x{i}" for i in range(10)), *base[10:]])]
    root = near_copies(texts)
    kept = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == sorted(set(root)) and len(kept) == 12


def test_partners_behind_nearer_strangers(spark):
    """120 texts, 0.78 alike, with 40 pairs of 0.81 among them: by sketch most have many strangers nearer than their partner. All pairs are found."""
    common, texts = [f"c{i}" for i in range(146)], []
    for k in range(80):
        opening = [f"o{k}x{i}" for i in range(3)]
        for one in range(2 if k < 40 else 1):
            texts.append(" ".join([*common, *opening, *(f"t{k}n{one}x{i}" for i in range(17))]))
    alike = [len(shingles(texts[x]) & shingles(texts[y])) / len(shingles(texts[x]) | shingles(texts[y])) for x, y in ((0, 1), (0, 2))]
    assert alike[1] < 0.8 < alike[0]
    kept = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == sorted(set(near_copies(texts))) and len(kept) == 80


def test_blocks_by_size(spark, monkeypatch):
    """Crowded cells in blocks of few shingles: texts at the edge of two kinds of size are compared, in every pair of blocks."""
    monkeypatch.setattr(simhash, "CROWDED", 2)
    monkeypatch.setattr(simhash, "LOAD", 700)
    common = [f"c{i}" for i in range(150)]
    texts = [" ".join([*common[: 150 - cut], *(f"g{g}x{i}" for i in range(more))]) for g, (cut, more) in enumerate((c, m) for c in range(0, 60, 4) for m in (0, 9, 18, 27))]
    kept = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == sorted(set(near_copies(texts)))


def test_large_group_of_near_copies(spark):
    """Some 900 variants of one text in one crowded cell: one stays, found by the crowded cells' least points."""
    base = [f"word{i}" for i in range(300)]
    rows = [(n, " ".join(f"edit{n}" if i == n % 290 else w for i, w in enumerate(base))) for n in range(900)]
    assert [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "bpe"]

    good = stages["quality classifier"](spark, docs, path)
    scored = Counter((r["doc_id"], r["predicted"]) for r in run(spark, "op10_quality_classifier", path))
    assert good.columns == columns
    assert Counter(r.doc_id for r in good.collect()) == Counter({i: n for (i, p), n in scored.items() if p})

    one = stages["simhash near-dedup"](spark, docs, path)
    assert one.columns == columns
    given = [(d["doc_id"], d["text"]) for d in rows(path, "documents")]
    root = near_copies([t for _, t in given])
    first = {}
    for (i, _), r in zip(given, root, strict=True):
        first[r] = min((i is None, i or 0), first.get(r, (i is None, i or 0)))
    firsts = Counter(None if n else i for n, i in first.values())
    stays = Counter(r.doc_id for r in one.collect())
    assert stays == firsts

    clean = stages["benchmark decontamination"](spark, docs, path)
    hit = {(r["doc_id"], r["n_words"]): r["contaminated"] for r in run(spark, "op5_benchmark_decontamination", path)}
    want = Counter((d["doc_id"], d["text"]) for d in rows(path, "documents") if not hit[d["doc_id"], len(norm(d["text"]))])
    assert clean.columns == columns and Counter((r.doc_id, r.text) for r in clean.collect()) == want

    safe = stages["secret scans"](spark, docs, path)
    spans = {}
    for r in run(spark, "op3_secret_scans", path):
        spans.setdefault((r["doc_id"]), []).append(r["spans"])
    assert safe.columns == columns and safe.count() == docs.count()
    for r in safe.collect():
        assert (r.text is None and r.n_chars == 0) or "[SECRET]" not in r.text or r.n_chars == len(r.text)
        assert r.text is None or "hunter2secret" not in r.text

    last = stages["bpe"](spark, docs, path)
    assert Counter(tuple(r) for r in last.collect()) == Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op4_bpe", path))


def test_run_is_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    out = P.run(spark, sf).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, docs.collect()))
    assert out and len({r.doc_id for r in out}) == len(out) < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(len(r.ids_sha256) == len(hashlib.sha256().hexdigest()) for r in out)


def test_empty(spark, empty):
    assert P.run(spark, empty).collect() == []


def test_clean_needs_a_window(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha, beta!")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]
