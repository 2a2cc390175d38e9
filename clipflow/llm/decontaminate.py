"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark items, each text scanned once.

Texts are normalised to words (A-Z lower-cased; digits, letters and everything beyond ASCII make words). A window is WINDOW
consecutive words of an item, or the whole of a shorter one. The automaton works on word numbers, so a match gives word
positions at once, and those are mapped to offsets in the original text.

Its patterns are ANCHOR words of an item, one every WINDOW - ANCHOR + 1, so that every window of the item holds one; a match is
extended over the words around it at all places of the anchor, and counts where it reaches a window. So the automaton has about half
a node for each benchmark word instead of ten. An anchor that begins at more than PLACES places of the benchmark ("which of the following")
is not used: each window that it was to cover gets the rarest ANCHOR words it holds, and a window all of whose words are so common
is a pattern itself, with the list of its items. So an occurrence costs PLACES comparisons at most, whatever the items share, and
the items of a window are gathered once a text. The automaton is built inside each task from the items, which are
broadcast: BLOCK_BYTES of them at most. A larger benchmark is dealt over as many blocks as that takes by a hash of id and text (equal texts
under many ids are dealt too); each block's automaton then reads the texts once and only what it finds is written, by the text's md5,
never the texts. Nothing is left out.

Null texts and item texts have no words; such items match nothing. Several rows with one item_id are one item; a null item_id
counts as the item named ''. Repeated documents are rows of their own. Other columns are passed through; those that have the
name of an output (n_words, hits, items) are replaced. Empty tables are fine on either side.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices, staged
from clipflow.llm.common import table as read

WINDOW, ANCHOR, BLOCK_BYTES = 10, 4, 16 << 20
#: Most places of an anchor in a block of the benchmark.
PLACES = 8
EVERY = WINDOW - ANCHOR + 1
#: Found texts that are sent to all executors instead of being joined by a shuffle.
FEW = 100_000
#: Every ASCII byte that is no letter or digit becomes a blank, A-Z become a-z, all others stay.
NORMAL = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Matcher:
    """items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]]):
        import ahocorasick

        self.names, self.number = [i for i, _ in items], {}
        number, flat, starts, spans = self.number, [-1] * EVERY, [], []  # -1: between items; words of no item are 0
        for _, text in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            starts.append(len(flat))
            spans.append(len(ids))
            flat += [*ids, -1]
        self.flat, self.starts = np.array(flat + [-1] * WINDOW, np.int32), np.array(starts, np.int64)
        often = occurrences(self.flat)
        anchors: dict[tuple, list[int]] = {}
        wholes: dict[tuple, list[int]] = {}
        for k, (start, n) in enumerate(zip(starts, spans, strict=True)):
            places, windows = chosen(often[start : start + n], n)
            for at in places:
                anchors.setdefault(tuple(flat[start + at : start + at + ANCHOR]), []).append(start + at)
            for at in windows:
                of = wholes.setdefault(tuple(flat[start + at : start + min(at + WINDOW, n)]), [])
                if not of or of[-1] != k:
                    of.append(k)
        patterns = list(dict.fromkeys([*anchors, *wholes]))
        self.anchors, self.wholes = ([held.get(p) for p in patterns] for held in (anchors, wholes))
        self.sizes = [len(p) for p in patterns]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, pattern in enumerate(patterns):
            self.automaton.add_word(pattern, k)
        self.automaton.make_automaton()
        self.empty = not patterns

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges [first, end) of hit words, and the items."""
        if self.empty or len(words) == 0:
            return [], set()
        get = self.number.get
        ids = tuple([get(w, 0) for w in words])
        found = list(self.automaton.iter(ids))
        if not found:
            return [], set()
        edge, items, listed = np.zeros(len(words) + 1, np.int64), set(), set()
        around = np.concatenate([np.full(EVERY, -2, np.int32), np.array(ids, np.int32), np.full(WINDOW, -2, np.int32)])
        for end, k in found:
            first = end + 1 - self.sizes[k]
            if (of := self.wholes[k]) is not None:
                edge[first] += 1
                edge[end + 1] -= 1
                if k not in listed:
                    listed.add(k)
                    items.update(of)
            if (at := self.anchors[k]) is not None:
                left, right, which = self.extended(around, first, np.array(at, np.int64))
                np.add.at(edge, first - left, 1)
                np.add.at(edge, end + 1 + right, -1)
                items.update(which.tolist())
        on = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
        step = np.diff(on)
        ranges = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
        return ranges, {self.names[i] for i in items}

    def extended(self, around: np.ndarray, first: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the places ``at`` of an anchor found at word ``first``: how far the words agree to its left and right, and the item, where that makes a window."""
        before, after = np.arange(1, EVERY), np.arange(ANCHOR, WINDOW)
        left = np.cumprod(self.flat[at[:, None] - before] == around[EVERY + first - before], 1).sum(1)
        right = np.cumprod(self.flat[at[:, None] + after] == around[EVERY + first + after], 1).sum(1)
        ok = left + ANCHOR + right >= WINDOW
        return left[ok], right[ok], np.searchsorted(self.starts, at[ok], "right") - 1


def occurrences(flat: np.ndarray) -> np.ndarray:
    """For each place, how often the ANCHOR words that begin there occur, by a hash of them (equal hashes only make words look more common)."""
    n = len(flat) - ANCHOR + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(ANCHOR):
        mixed = (mixed ^ flat[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, which, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    return counts[which]


def chosen(often: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Places of an item of ``n`` words that become anchors, and those of windows that are patterns themselves; they cover all its windows."""
    if n < WINDOW:
        return [], [0] if n else []
    regular = np.arange(0, n - ANCHOR + 1, EVERY)
    rare = often[regular] <= PLACES
    if rare.all():
        return regular.tolist(), []
    places, windows = set(regular[rare].tolist()), []
    for at in regular[~rare].tolist():
        for first in range(max(0, at - EVERY + 1), min(at, n - WINDOW) + 1):
            best = first + int(np.argmin(often[first : first + EVERY]))
            if often[best] <= PLACES:
                places.add(best)
            else:
                windows.append(first)
    return sorted(places), windows


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def blocks_of(benchmark: DataFrame):
    """Lists of (item_id, text), each of about BLOCK_BYTES, and how many there are; the driver holds one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield n, [(r.item, r.text) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, hits (merged code point spans of hit words in the original), n_hit and items (ids, sorted as strings)."""
    df = docs.drop(*(c for c in docs.columns if c in OUTPUTS and c != text))
    context, found = docs.sparkSession.sparkContext, None
    for n, block in blocks_of(benchmark):
        held = context.broadcast(block)  # BLOCK_BYTES
        if n == 1:
            return map_slices(df, judge(held, text, df.schema.fields, with_text), outputs(df, text, with_text))
        part = staged(map_slices(df.select(F.col(text).alias("t")), finder(held), FOUND), "found").dropDuplicates(["key"])  # equal texts have equal finds
        found = part if found is None else found.union(part)
    every = staged(found.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items")), "hits")  # a row a block at most for each text
    small = F.broadcast(every) if every.count() <= FEW else every
    boxed = df.select(F.struct("*").alias("row"), F.md5(F.col(text).cast("binary")).alias("key")).join(small, "key", "left").select("row.*", F.col("ranges").alias("__ranges"), F.col("items").alias("__items"))
    return map_slices(boxed, judge(None, text, df.schema.fields, with_text), outputs(df, text, with_text))


OUTPUTS = {"n_words": T.LongType(), "items": T.ArrayType(T.StringType()), "hits": SPANS, "n_hit": T.LongType()}
FOUND = T.StructType([T.StructField("key", T.StringType()), T.StructField("ranges", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def outputs(df: DataFrame, text: str, with_text: bool) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in OUTPUTS and (f.name != text or with_text)]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in OUTPUTS.items())])


def pairs(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in ranges]


def finder(block):
    """Per text in which the block's items occur: its md5, the word ranges and the items."""
    held: list[Matcher] = []

    def step(batch):
        if not held:
            held.append(Matcher(block.value))
        rows = []
        for t in batch.column("t").to_pylist():
            ranges, items = held[0](words_of(t))
            if ranges:
                rows.append((hashlib.md5(t.encode()).hexdigest(), pairs(ranges), sorted(items)))
        return dict(zip(("key", "ranges", "items"), zip(*rows, strict=True), strict=True)) if rows else None

    return step


def judge(block, text: str, fields: list[T.StructField], with_text: bool):
    """The outputs of each row, from the one block's automaton or (None) from the finds that were joined to it."""
    held: list[Matcher] = []

    def step(batch):
        if block is not None and not held:
            held.append(Matcher(block.value))
        texts = batch.column(text).to_pylist()
        if block is not None:
            finds = ((words, *held[0](words)) for words in map(words_of, texts))
        else:
            ranges = [merged([(r["start"], r["end"]) for r in rs or []]) for rs in batch.column("__ranges").to_pylist()]
            finds = ((words_of(t), r, set(i or [])) for t, r, i in zip(texts, ranges, batch.column("__items").to_pylist(), strict=True))
        rows: dict[str, list] = {n: [] for n in OUTPUTS}
        for t, (words, found, items) in zip(texts, finds, strict=True):
            rows["n_words"].append(len(words))
            rows["items"].append(sorted(items))
            rows["hits"].append(pairs(original_spans(t, found)) if found else [])
            rows["n_hit"].append(sum(b - a for a, b in found))
        return {f.name: batch.column(f.name) for f in fields if f.name not in OUTPUTS and (f.name != text or with_text)} | rows

    return step


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no benchmark window occurs in, with their own columns."""
    boxed = docs.select(F.struct("*").alias("row"), F.col(text).alias("__text"))
    return scan(boxed, benchmark, "__text", with_text=False).where("n_hit = 0").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), with_text=False)
    return docs.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: The same from the definition: every window of every length that occurs among the items, joined with the documents' word runs.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(words) - 10 + 1, 1) + 1)) AS r(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, size, i, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM w, sizes, unnest(range(1, len(words) - size + 2)) AS r(i) WHERE len(words) >= size),
hit AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, win)),
hw AS (SELECT rid, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + size)) AS r(k) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
