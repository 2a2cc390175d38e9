"""The automaton of anchors against windows looked up one by one, and large benchmarks."""

import random
import resource
import time

import pytest

from clipflow.llm import decontaminate as D


def brute(items, words):
    windows = {}
    for name, text in items:
        w = D.words_of(text)
        for i in range(max(1, len(w) - D.WINDOW + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + D.WINDOW]), set()).add(name)
    hit, found = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if (of := windows.get(tuple(words[i : i + size]))) is not None:
                hit.update(range(i, i + size))
                found |= of
    return hit, found


def test_matcher_by_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        text = lambda n: " ".join(rng.choice("abc") if rng.random() < 0.97 else "rare" for _ in range(n))
        items = [(f"i{rng.randint(0, 12)}", text(rng.choice([0, 1, 2, 4, 5, 9, 10, 11, 17, 40]))) for _ in range(rng.randint(0, 12))]
        cut = [i for _, i in items if i]
        body = " ".join(rng.choice([text(8), rng.choice(cut) if cut else "z", " ".join((rng.choice(cut) if cut else "z").split()[2:14])]) for _ in range(4))
        ranges, found = D.Matcher(items)(D.words_of(body))
        assert ({i for a, b in ranges for i in range(a, b)}, found) == brute(items, D.words_of(body))


@pytest.mark.parametrize("most", [0, 1, 8])
def test_common_openings_by_brute_force(monkeypatch, most):
    """Anchors given up for rarer ones and for whole windows find the same."""
    monkeypatch.setattr(D, "PLACES", most)
    rng = random.Random(most)
    for _ in range(150):
        text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
        opening = text(rng.choice([4, 9, 12, 20]))
        items = [(f"i{rng.randint(0, 30)}", f"{opening} {text(rng.choice([0, 3, 12]))} {opening if rng.random() < 0.2 else ''}") for _ in range(rng.randint(1, 40))]
        body = " ".join(rng.choice([opening, rng.choice(items)[1], text(5)]) for _ in range(6))
        ranges, found = D.Matcher(items)(D.words_of(body))
        assert ({i for a, b in ranges for i in range(a, b)}, found) == brute(items, D.words_of(body))


@pytest.mark.parametrize("shared", [4, 12])
def test_fifty_thousand_items_with_one_opening(shared):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    opening = " ".join(f"o{i}" for i in range(shared))
    items = [(str(i), f"{opening} {' '.join(rng.choices(words, k=20))}") for i in range(50_000)]
    m = D.Matcher(items)
    body = D.words_of(" ".join(f"{opening} {rng.choice(words)}" for _ in range(10_000 // (shared + 1))) + " " + items[4][1])
    began = time.process_time()
    ranges, found = m(body)
    assert time.process_time() - began < 1 and (len(found) == 50_000 if shared > 10 else found == {"4"})
    assert ranges[-1] == (len(body) - shared - 20, len(body)) if shared < 10 else ranges[-1][1] == len(body)


def test_twenty_megabytes_in_a_few_scans(spark, monkeypatch):
    """A text is read once for 16 MB of benchmark, and the automaton is small."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 8))) for _ in range(50_000)]
    items = [(i, " ".join(rng.choices(words, k=200))) for i in range(17_000)]
    assert sum(len(t) for _, t in items) > 20_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    m = D.Matcher([(str(i), t) for i, t in items[:13_000]])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000
    assert m(D.words_of("x " + items[77][1]))[0] == [(1, 201)]
    scans = []
    monkeypatch.setattr(D, "finder", lambda block, f=D.finder: scans.append(1) or f(block))
    docs = spark.createDataFrame([(k, f"start {' '.join(items[k * 300][1].split()[50:75])} end") for k in range(50)] + [(99, "nothing of it " * 50)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in D.scan(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: (25, [str(k * 300)]) for k in range(50)} | {99: (0, [])} and len(scans) == 2


def test_equal_items_under_many_ids(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    bench = spark.createDataFrame([(i, "the same words in every item of all of these many") for i in range(200)], "item_id long, text string")
    assert max(len(block) for _, block in D.blocks_of(bench)) < 120
    docs = spark.createDataFrame([(1, "so the same words in every item of all of these many."), (1, "so the same words in every item of all of these many."), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in D.scan(docs, bench).collect()) == [(1, 12, 11, 200), (1, 12, 11, 200), (2, 0, 0, 0)]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_names_of_outputs_are_replaced_and_others_stay(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    names = ["key", "row", "ranges", "t", "__text", "n_words", "hits", "items", "n_hit"]
    docs = spark.createDataFrame([(1, "alpha beta", *"abcdefghi")], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "and so on and on for some more")], "item_id long, text string")
    r = D.scan(docs, bench).first()
    assert (r.n_words, r.n_hit, r["items"], r.key, r.row, r.ranges, r.t, r["__text"]) == (2, 2, ["1", "2"], "a", "b", "c", "d", "e")
    clean = D.clean(docs, spark.createDataFrame([(3, "gamma")], "item_id long, text string"))
    assert clean.columns == docs.columns and [tuple(x) for x in clean.collect()] == [tuple(docs.first())]
