"""Operators 11 to 13 and very long blanks, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import differences, duck

from clipflow.llm import bpe, filter_audit, packing, periodic_runs
from clipflow.llm.queries import ORACLES, QUERIES

BLANK = re.compile(r"[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(path, name):
    return pq.read_table(f"{path}/{name}.parquet").to_pylist()


def words(text):
    return [w for w in BLANK.split(text or "") if w]


@pytest.fixture(params=["edge", "sf"])
def path(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


# blanks


def long_blanks():
    n = 1_000_000
    yield from (" " * n, "\n" * n, "\t" * n, "hello" + " " * n + "world it's", "a" + "\xa0" * n, "\r\n" * 600_000, "x \n" * 10 + " \t\n" * 400_000 + "end")
    yield "a " + " " * n + "<|endoftext|>" + " " * 20_000 + "b" + "\n" * 20_000
    yield "\n" * 16_384 + "!" + " " * 16_383 + "b" + " " * 16_384 + "1"
    yield (" " * 100_000 + "word\n" + "\t" * 50_000) * 70  # 10 MB


def test_bpe_of_very_long_blanks(tokenizer):
    encoder = bpe.Encoder(bpe.vocabulary_path())
    for text in long_blanks():
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder(text).tolist() == want and encoder.vocabulary.decode(want) == text


def test_pipeline_stage_of_very_long_blanks(spark, tokenizer):
    import corpus_pipeline

    texts = [" " * 1_000_000, "word" + "\n" * 1_000_000 + "word"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t))


# operator 11


def audit_by_hand(docs, labels):
    """Every order and step from sets of row numbers."""
    fails = {f: set() for f in "ABCDE"}
    texts = [(d["text"] or "") for d in docs]
    for i, (d, t) in enumerate(zip(docs, texts, strict=True)):
        w = words(t)
        fails["A"] |= {i} if len(w) < 200 else set()
        fails["B"] |= {i} if 100 * len(set(w)) < 50 * len(w) else set()
        fails["C"] |= {i} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails["D"] |= {i} if re.search("[#$%&*|]", t) else set()
        fails["E"] |= {i} if any(u == t and o["doc_id"] is not None and d["doc_id"] is not None and o["doc_id"] < d["doc_id"] for o, u in zip(docs, texts, strict=True)) else set()
    good = {r["doc_id"] for r in labels if r["quality"] == 1} - {None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1} - {None}
    out = []
    for part in {d["source"] or "" for d in docs}:
        own = {i for i, d in enumerate(docs) if (d["source"] or "") == part}
        shapley = Counter()
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = set(own)
            for k, f in enumerate(order):
                failing = fails[f] & own
                removed = failing & alive
                alone = {i for i in failing if all(i not in fails[g] for g in "ABCDE" if g != f)}
                alive = alive - removed
                shapley[f] += len(removed)
                found.append((part, order, k + 1, len(alive), len(removed), len(failing) - len(removed), len(alone), sum(docs[i]["doc_id"] in good for i in removed), sum(docs[i]["doc_id"] in toxic for i in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return Counter(out)


def test_op11(spark, path):
    got = Counter(tuple(r) for r in QUERIES["op11_filter_audit"](spark, path).collect())
    assert got == audit_by_hand(rows(path, "documents"), rows(path, "labels"))


def test_op11_sql(spark, path):
    assert not differences(QUERIES["op11_filter_audit"](spark, path), duck_of(path), ORACLES["op11_filter_audit"])


def duck_of(path):
    import duckdb

    if path.endswith("sf0.001"):
        return duck(path)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def test_op11_parts_and_hot_text(spark, tmp_path, monkeypatch):
    """A part in which nothing fails has zeros; a text that most rows have is one group, joined by broadcast or not."""
    clean = " ".join(f"word{i}" for i in range(250))
    docs = [(i, "same text", "hot") for i in range(400)] + [(1000 + i, clean + f" {i}", "clean") for i in range(5)] + [(None, "same text", None), (2000, None, "hot"), (2001, "", "hot")]
    rows_ = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    plain = [{"doc_id": i, "text": t, "source": s} for i, t, s in docs]
    want = audit_by_hand(plain, [r.asDict() for r in labels.collect()])
    for share in (1 / 1000, 1.0):
        monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
        measured = filter_audit.staged(filter_audit.measured(rows_, "text", "doc_id", "source").withColumn("id", filter_audit.F.monotonically_increasing_id()), "m")
        held = filter_audit.staged(filter_audit.with_repeats(measured), "r")
        losses = {"good_lost": filter_audit.labelled(held, labels, "quality"), "toxic_lost": filter_audit.labelled(held, labels, "toxic")}
        got = filter_audit.audit(held.select("id", "part"), filter_audit.failing(held, filter_audit.FILTERS), losses)
        assert Counter(tuple(r) for r in got.collect()) == want


def test_op11_general(spark):
    """Any number of filters and labels, given as relations of ids."""
    rng = random.Random(8)
    ids = list(range(300))
    fails = {f: {i for i in ids if rng.random() < p} for f, p in (("x", 0.5), ("y", 0.2), ("z", 0.0))}
    liked = {i for i in ids if rng.random() < 0.3}
    frame = lambda s: spark.createDataFrame([(i, "p" if i % 3 else "q") for i in s], "id long, part string")
    got = filter_audit.audit(frame(ids), {f: frame(s) for f, s in fails.items()}, {"liked": frame(liked).select("id")}).collect()
    assert len(got) == 2 * 6 * 3
    for r in got:
        own = {i for i in ids if (i % 3 > 0) == (r["part"] == "p")}
        f, front = r["filter_order"][r["step"] - 1], r["filter_order"][: r["step"] - 1]
        gone = set().union(*(fails[g] for g in front))
        removed = (fails[f] - gone) & own
        assert (r["kept"], r["removed"], r["redundant"], r["liked"]) == (len(own - gone - fails[f]), len(removed), len(fails[f] & gone & own), len(removed & liked))


# operator 12


def runs_by_hand(w):
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def structured(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return [rng.choice("ab"[: rng.randint(1, 2)] + "cdefgh"[: rng.randint(0, 5)]) for _ in range(rng.randint(1, 30))]
    if kind < 0.7:
        x = structured(rng, depth + 1)
        return [x[i % len(x)] for i in range(min(len(x) * rng.randint(2, 8) + rng.randint(0, len(x)), 400))]
    return structured(rng, depth + 1) + structured(rng, depth + 1)


def test_runs_of_nested_repetition():
    rng, found = random.Random(3), 0
    for _ in range(1200):
        w = [x.encode() for x in structured(rng)]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = b"z"
        want = runs_by_hand(w)
        assert periodic_runs.runs(w) == want, w
        found += len(want)
    assert found > 1000


def test_runs_of_very_long_texts():
    """One word a million times, short periods, and runs beside each other: time and memory in proportion."""
    n = 1_000_000
    assert periodic_runs.runs([b"x"] * n) == [(0, n, 1)]
    assert periodic_runs.runs([b"a", b"a", b"b"] * (n // 3)) == [(0, n // 3 * 3, 3)]
    half = [b"x"] * (n // 4)
    assert periodic_runs.runs([*half, b"y", *half]) == [(0, n // 4, 1), (n // 4 + 1, n // 4, 1)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic_runs.runs(b) == runs_by_hand(b)


def test_runs_do_not_depend_on_the_hash(monkeypatch):
    monkeypatch.setattr(periodic_runs, "MIX", np.uint64(0))  # all contexts collide
    w = ("one two three four five six seven eight " * 7 + "and then some other words").encode().split()
    assert periodic_runs.runs(w) == runs_by_hand(w)


def test_op12(spark, path):
    want = Counter()
    for d in rows(path, "documents"):
        w = words(d["text"])
        if d["doc_id"] is not None and w:
            h = zlib.crc32(str(d["doc_id"]).encode())
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            if h % 10 == 0:
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = runs_by_hand(w) if len(w) < 5000 else periodic_runs.runs([x.encode() for x in w])
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[d["doc_id"], len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))] += 1
    got = Counter(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, path).collect())
    assert got == want and any(k[1] for k in got)


def test_collapse_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([("r", 1, "a b " * 20, "c"), ("r", 2, None, None)], "runs string, row int, text string, n_words string")
    got = sorted(periodic_runs.collapse(docs).collect(), key=lambda r: r["row"])
    assert got[0]["collapsed"] == "a b" and [tuple(r) for r in got[0]["runs"]] == [(0, 40, 2)] and got[0]["n_words"] == "c"
    assert got[1]["collapsed"] == "" and got[1]["runs"] == []


# operator 13


def bound(counts):
    return -(-int((counts * np.arange(len(counts))).sum()) // (len(counts) - 1))


def check_plan(counts, plan):
    """Every piece has one place, and no sequence holds more than it can."""
    capacity = len(counts) - 1
    used = np.zeros(capacity + 1, np.int64)
    for free, kinds in enumerate(plan.kinds):
        for times, content in kinds:
            assert times > 0 and sum(n * k for n, k in content) == capacity - free
            for n, k in content:
                used[n] += times * k
    assert (used == counts).all()
    entries, sequences = plan.entries()
    assert sequences == sum(t for kinds in plan.kinds for t, _ in kinds)
    return sequences


def test_plans():
    rng = np.random.default_rng(5)
    cases = {
        "even": np.bincount(rng.integers(1, 1025, 30_000), minlength=1025), "small": np.bincount(rng.integers(1, 100, 30_000), minlength=1025), "halves": np.bincount(rng.integers(330, 530, 30_000), minlength=1025),
        "prose": np.bincount(np.minimum(rng.lognormal(6, 0.8, 50_000).astype(int) + 1, 1024), minlength=1025), "one": np.bincount([7], minlength=1025), "same": np.bincount([300] * 1000, minlength=1025), "none": np.zeros(1025, int),
    }
    for name, counts in cases.items():
        n = check_plan(counts, packing.plan(counts))
        if name in ("even", "small", "prose"):
            assert n <= 1.005 * bound(counts) + 2, (name, n, bound(counts))
    assert check_plan(cases["same"], packing.plan(cases["same"])) == 334
    grown = cases["prose"] * 1_000_000  # the plan is as large for a million times the pieces
    plan = packing.plan(grown)
    assert check_plan(grown, plan) <= 1.005 * bound(grown) and len(plan.entries()[0]) < 6000


def test_configurations_are_near_the_least():
    """Against every configuration's program solved by hand: two lengths that fit only together."""
    config, used = packing.configurations(np.array([600, 424, 200]), np.array([100, 100, 50]), 1024)
    assert abs(used.sum() - 110) < 0.5 and (np.array([600, 424, 200]) @ config <= 1024).all()


def test_op13(spark, path, tokenizer):
    docs = rows(path, "documents")
    want = Counter()
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [(0, first)] + [(at, at + 1024) for at in range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(cuts):
            want[d["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = QUERIES["op13_best_fit_packing"](spark, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.01 * -(-sum(r["length"] for r in got) // 1024) + 2


def test_pack_with_ids_and_clashing_columns(spark, tokenizer):
    docs = spark.createDataFrame([("r", 1, "some words here " * 700, "c"), ("r", 1, "some words here " * 700, "c"), ("s", None, None, None)], "row string, doc_id long, text string, offset string")
    got = packing.pack(docs, bpe.vocabulary_path(), capacity=1000, keep_ids=True).collect()
    ids = [*tokenizer.encode("some words here " * 700, add_special_tokens=False).ids, 2]
    assert sorted(i for r in got for i in r["ids"]) == sorted([*ids, *ids, 2])
    assert {r["row"] for r in got} == {"r", "s"} and all(isinstance(r["offset"], int) for r in got)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
