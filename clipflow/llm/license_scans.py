"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII; a shingle is SHINGLE words. Templates are put
into classes of like size. In a class whose largest template has L shingles the text has windows of 2 L shingles, one every L, so a
run of up to L shingles lies whole in some window. A template of T shingles of which c >= CONTAINED * T stand in that window has a Jaccard
similarity of c / (2 L + T - c) or more with it. A band is one MinHash value; a class has as many bands as make the chance of no
collision MISS or less for its least template. A collision only nominates a template: the words of the windows around are then compared one
by one, and each place where CONTAINED of the template's shingles stand within 2 L of each other is one match.

Null texts and texts of fewer than SHINGLE words have no shingles and match nothing. A template of fewer words is refused. Repeated
rows stay rows; an empty table gives an empty result; extra columns are not read. A very long text is hashed PIECE bytes at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices
from clipflow.llm.common import table as read
from clipflow.llm.licenses import TEMPLATES

SHINGLE, CONTAINED, MISS = 5, 0.8, 0.001
#: Bytes of text that are hashed at a time (a longer word is hashed whole).
PIECE = 1 << 20
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64)
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def powers(of: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, of, np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(codes):
        end = at + PIECE
        while end < len(codes) and IS_WORD[codes[end - 1]]:
            end += 1
        part = codes[at:end]
        step = np.diff(np.concatenate([[False], IS_WORD[part], [False]]).astype(np.int8))
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((LOWER[part] + np.uint64(1)) * powers(BASE, len(part))[:-1])])
        hashes.append(mix((sums[stop] - sums[start]) * powers(INVERSE, len(part))[start]))
        starts.append(start + at)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts one after the other, and where each text's begin (one more entry at the end)."""
    raws = [(t or "").encode() for t in texts]
    ends_of_text = np.cumsum([len(r) + 1 for r in raws])
    start, words = word_hashes(np.frombuffer(b"\n".join([*raws, b""]), np.uint8))
    n_words = np.diff(np.concatenate([[0], np.searchsorted(start, ends_of_text)]))
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = mix(h + words[k : k + n] * np.uint64(2 * k + 3))
    n_own = np.maximum(n_words - SHINGLE + 1, 0)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    at = np.repeat(first - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())
    return h[at], np.concatenate([[0], np.cumsum(n_own)])


def bands_of(sizes: list[int], window: int) -> int:
    """Bands that nominate each template of these numbers of shingles, CONTAINED of it standing in a window, with a chance of 1 - MISS or more."""
    held = [(math.ceil(CONTAINED * t), t) for t in sizes]
    least = min(c / (window + t - c) for c, t in held)
    return math.ceil(math.log(MISS) / math.log(1 - least))


def occurrences(at: list[tuple[int, tuple[str, ...]]], own: Counter, reach: int) -> list[tuple[int, int, float]]:
    """(first, last, containment) of each place where CONTAINED of the shingles ``own`` stand within ``reach``. at: their places, in order.

    A place ends where a shingle comes again more often than the template has it, or beyond ``reach``; so two notices in a row are two places.
    """
    out: list[tuple[int, int, float]] = []
    held: deque[tuple[int, tuple[str, ...]]] = deque()
    counts: Counter = Counter()

    def full() -> bool:
        return len(counts) >= CONTAINED * len(own)

    def close() -> None:
        if full():
            out.append((held[0][0], held[-1][0], len(counts) / len(own)))
        held.clear()
        counts.clear()

    for i, s in at:
        if held and (counts[s] == own[s] or i - held[0][0] >= reach):
            if full():
                close()
            while held and (counts[s] == own[s] or i - held[0][0] >= reach):
                _, t = held.popleft()
                counts[t] -= 1
                if not counts[t]:
                    del counts[t]
        held.append((i, s))
        counts[s] += 1
    close()
    return out


FACTORS = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Index:
    """The templates, by class: their MinHash values per band, and their shingles as word tuples."""

    templates: dict[str, str]
    shingles: dict[str, Counter] = field(default_factory=dict)
    classes: dict[int, tuple[int, list[dict[int, list[str]]]]] = field(default_factory=dict)

    def __post_init__(self):
        by_size: dict[int, list[str]] = {}
        for name, text in self.templates.items():
            words = [w.lower() for w in WORD.findall(text)]
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.shingles[name] = Counter(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))
            by_size.setdefault(math.ceil(math.log2(len(words) - SHINGLE + 1)), []).append(name)
        for names in by_size.values():
            held = {n: np.unique(shingle_hashes([self.templates[n]])[0]) for n in names}
            size = max(sum(self.shingles[n].values()) for n in names)
            bands = bands_of([len(h) for h in held.values()], 2 * size)
            if bands > len(FACTORS):
                raise ValueError(f"{bands} bands are more than there are")
            tables: list[dict[int, list[str]]] = [{} for _ in range(bands)]
            for n, h in held.items():
                for b in range(bands):
                    tables[b].setdefault(int((h * FACTORS[b]).min()), []).append(n)
            self.classes[size] = (bands, tables)

    def nominate(self, texts: list[str | None]) -> set[tuple[int, int, int, str]]:
        """(text, first shingle, size, template) of windows that share a band value with a template."""
        h, starts = shingle_hashes(texts)
        found: set[tuple[int, int, int, str]] = set()
        if not len(h):
            return found
        n = np.diff(starts)
        for size, (bands, tables) in self.classes.items():
            blocks = -(-n // size)
            block_first = np.repeat(starts[:-1], blocks) + size * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            owner = np.repeat(np.arange(len(n)), blocks)
            joined = np.concatenate([owner[1:] == owner[:-1], [False]])
            for b in range(bands):
                least = np.minimum.reduceat(h * FACTORS[b], block_first)
                least = np.minimum(least, np.where(joined, np.concatenate([least[1:], [NONE]]), NONE))
                keys = np.array(sorted(tables[b]), np.uint64)
                near = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
                for w in np.flatnonzero(keys[near] == least):
                    found.update((int(owner[w]), int(block_first[w] - starts[owner[w]]), size, t) for t in tables[b][int(least[w])])
        return found

    def matches(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """Per text: (template, containment, start, end) in code points of each place, verified word by word."""
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        asked: dict[int, dict[str, list[tuple[int, int, int]]]] = {}
        for doc, first, size, name in sorted(self.nominate(texts)):
            regions = asked.setdefault(doc, {}).setdefault(name, [])
            low, high = max(0, first - size), first + 3 * size + SHINGLE  # the windows around, so that no place is cut
            if regions and low <= regions[-1][1]:
                regions[-1] = (regions[-1][0], high, size)
            else:
                regions.append((low, high, size))
        for doc, of in asked.items():
            words = self.words_in(texts[doc], sorted((a, b) for rs in of.values() for a, b, _ in rs))
            for name, regions in of.items():
                own = self.shingles[name]
                for low, high, size in regions:
                    at = [(i, s) for i in range(low, high) if i + SHINGLE - 1 in words and (s := tuple(words[k][0] for k in range(i, i + SHINGLE))) in own]
                    out[doc] += [(name, share, words[a][1], words[b + SHINGLE - 1][2]) for a, b, share in occurrences(at, own, 2 * size)]
            out[doc].sort()
        return out

    @staticmethod
    def words_in(text: str, ranges: list[tuple[int, int]]) -> dict[int, tuple[str, int, int]]:
        """The words of these ranges of word numbers, with their offsets; others are passed over and not kept."""
        words: dict[int, tuple[str, int, int]] = {}
        k = 0
        reach = ranges[0][1]
        for i, m in enumerate(WORD.finditer(text)):
            while k < len(ranges) and ranges[k][0] <= i:
                reach = max(reach, ranges[k][1])
                k += 1
            if k and i < reach:
                words[i] = (m[0].lower(), *m.span())
            elif k == len(ranges):
                break
        return words


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Per document: doc_id, licenses (sorted names), matches (license, containment, start, end)."""
    held: list[Index] = []
    given = templates or TEMPLATES

    def step(batch):
        if not held:
            held.append(Index(given))
        got = held[0].matches(batch.column(text).to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "licenses": [sorted({m[0] for m in ms}) for ms in got],
            "matches": [[{"license": n, "containment": s, "start": a, "end": b} for n, s, a, b in ms] for ms in got],
        }

    match = "array<struct<license:string,containment:double,start:int,end:int>>"
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"licenses array<string>, matches {match}").fields])
    return map_slices(docs.select("doc_id", text), step, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), F.array_max("matches.containment").alias("best_containment"))
