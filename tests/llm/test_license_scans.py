"""Every template is found where it is planted, once a place; containment by brute force; memory of long texts."""

import math
import random
import resource

import pytest

from clipflow.llm import license_scans as L

WORDS = "the model was trained on many pages of software and any person may use it under these terms for free without a fee".split()


@pytest.fixture(scope="module")
def index():
    return L.Index(L.TEMPLATES)


def brute(text, name, index):
    """Places by looking at every shingle of the text."""
    spans = [m.span() for m in L.WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    own = index.shingles[name]
    size = next(s for s, (_, tables) in index.classes.items() if any(name in ns for ns in tables[0].values()))
    at = [(i, s) for i in range(len(words) - L.SHINGLE + 1) if (s := tuple(words[i : i + L.SHINGLE])) in own]
    return [(name, share, spans[a][0], spans[b + L.SHINGLE - 1][1]) for a, b, share in L.occurrences(at, own, 2 * size)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("name", L.TEMPLATES)
def test_found_once_wherever_it_stands(index, name):
    rng, notice = random.Random(name), L.TEMPLATES[name]
    texts = [f"{prose(rng, rng.randint(0, 600))}. {notice} {prose(rng, rng.randint(0, 400))}" for _ in range(120)]
    missed = 0
    for text, got in zip(texts, index.matches(texts), strict=True):
        own = [m for m in got if m[0] == name]
        assert len(own) <= 1, text
        missed += not own
        for _, share, a, b in own:
            assert share == 1 and L.WORD.findall(text[a:b]) == L.WORD.findall(notice)
    assert missed <= 1


def test_containment_by_brute_force(index):
    """Notices with words changed, cut or doubled: what is found is what every shingle says."""
    rng, wanted, found = random.Random(2), 0, 0
    for _ in range(150):
        parts = []
        for name in rng.choices(list(L.TEMPLATES), k=2):
            words = L.TEMPLATES[name].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(["changed", "", "two words"])
            parts += [prose(rng, rng.randint(0, 80)), " ".join(words) if rng.random() < 0.8 else L.TEMPLATES[name] + " " + L.TEMPLATES[name]]
        text = " ".join(parts)
        want = sorted(m for name in L.TEMPLATES for m in brute(text, name, index))
        got = index.matches([text])[0]
        assert set(got) <= set(want)
        wanted, found = wanted + len(want), found + len(got)
    assert wanted > 200 and found >= 0.995 * wanted


def test_two_in_a_row_are_two(index):
    notice = L.TEMPLATES["MIT-permission"]
    assert [m[0] for m in index.matches([f"{notice} {notice}"])[0]].count("MIT-permission") == 2


def test_bands_keep_the_bound(index):
    for size, (bands, tables) in index.classes.items():
        for name in {n for ns in tables[0].values() for n in ns}:
            t = len(index.shingles[name])
            c = math.ceil(L.CONTAINED * t)
            assert (1 - c / (2 * size + t - c)) ** bands <= L.MISS


def test_a_long_text_takes_little_memory(index):
    rng = random.Random(1)
    text = prose(rng, 3_000_000) + " " + L.TEMPLATES["MIT"]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [m[0] for m in index.matches([text])[0]] == ["MIT"]
    assert len(text) > 13_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 450_000


def test_pieces_give_the_same_hashes(monkeypatch):
    texts = [prose(random.Random(4), 500), "", None, "x" * 300, "ünï cödé " * 40]
    whole = L.shingle_hashes(texts)
    monkeypatch.setattr(L, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(whole, L.shingle_hashes(texts), strict=True))
