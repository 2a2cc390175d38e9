"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts texts into chunks, so equal passages give equal chunks wherever they stand. A
chunk's core runs from its first anchor to its last: places where a letter is followed by a blank and a letter, at which the
pattern that splits text before the merges starts a piece in every reading. Cores are encoded once and reused; each join
between two cores is repaired by encoding the text between them together with the word on either side, and is accepted when
those words get the ids they had; else it is widened by the core on the side that disagrees and encoded again, until they agree.

Documents that share content are sent to the same task: they are dealt by the least hash of their chunks, and a least hash
that very many documents have is dealt over several tasks. So the store of encoded chunks is local to a task and bounded
(STORE_BYTES of text; it is emptied when full), and a chunk is encoded once for each task that meets it. The text is shuffled
once; ids are not.

Null text counts as empty: no ids. Very long runs of blanks are cut out by rule (LONG_BLANKS); chunks longer than LONGEST_KEPT
are encoded wherever they stand and not kept for reuse. Repeated rows stay rows. An empty table gives an empty result. Columns ids and text of the
result replace columns of those names; all others are passed through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices
from clipflow.llm.common import table as read

#: The split pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of this many blanks are cut out before the pattern meets them; blanks as the pattern has them (Unicode White_Space).
LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{16384,}")
#: LONGEST_KEPT: a longer chunk is encoded each time; few texts go so long without a cut.
WINDOW, MEAN_BITS, STORE_BYTES, LONGEST_KEPT = 16, 10, 24 << 20, 1 << 15
#: A least hash that more documents have than this share of them (and than LEAST_HOT) is dealt over several tasks.
HOT_SHARE, LEAST_HOT = 1 / 1000, 500
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
FACTOR = 0x9E3779B1
IS_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and (b < 127 or 161 <= b) and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        pieces = {i: p for p, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

    def encode(self, raw: bytes) -> np.ndarray:
        text = raw.decode()
        if not LONG_BLANKS.search(text):
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        parts = [np.zeros(0, np.uint32)]
        for k, segment in enumerate(self.special.split(text) if self.special else [text]):
            parts += self.with_long_blanks(segment) if k % 2 == 0 else [self.encoding.encode_to_numpy(segment, allowed_special="all")]
        return np.concatenate(parts)

    def with_long_blanks(self, text: str) -> Iterator[np.ndarray]:
        """The pattern takes a run of blanks as one piece up to its last blank, or whole at the end of the text. Cut there, since
        its search steps back through the run blank by blank and would run out of stack in a very long one."""
        at = 0
        for run in LONG_BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            yield self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=())
            yield np.array(self.encoding._encode_single_piece(text[run.start() : end].encode()), np.uint32)
            at = end
        yield self.encoding.encode_to_numpy(text[at:], disallowed_special=())

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def cuts(raw: bytes) -> list[int]:
    """Where chunks end, by the rolling hash; never inside a character."""
    codes = np.frombuffer(raw, np.uint8)
    if len(codes) <= WINDOW:
        return [len(codes)]
    h, factor = GEAR[codes], FACTOR
    for k in (1, 2, 4, 8):
        h = h[k:] + h[:-k] * np.uint32(factor)
        factor = factor * factor % (1 << 32)
    ends = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + WINDOW
    ends = ends[ends < len(codes)]
    ends = ends[(codes[ends] & 0xC0) != 0x80]
    return [*ends.tolist(), len(codes)]


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def anchors(chunk: bytes) -> np.ndarray:
    codes = np.frombuffer(chunk, np.uint8)
    letter = IS_LETTER[codes]
    return np.flatnonzero(letter[:-2] & (codes[1:-1] == 32) & letter[2:]) + 1


class Encoder:
    def __init__(self, path: str):
        self.vocabulary, self.store, self.held = Vocabulary(path), {}, 0
        self.reused = self.encoded = self.repaired = 0

    def core(self, chunk: bytes):
        """head, ids, first word, its ids, last word, its ids, tail; None if the chunk has fewer than three anchors."""
        if chunk in self.store:
            self.reused += 1
            return self.store[chunk]
        at = anchors(chunk)
        if len(at) < 3:
            return None
        a, b, y, z = int(at[0]), int(at[1]), int(at[-2]), int(at[-1])
        encode = self.vocabulary.encode
        found = chunk[:a], encode(chunk[a:z]), chunk[a:b], encode(chunk[a:b]), chunk[y:z], encode(chunk[y:z]), chunk[z:]
        self.encoded += 1
        if len(chunk) <= LONGEST_KEPT:
            if self.held > STORE_BYTES:
                self.store, self.held = {}, 0
            self.store[chunk] = found
            self.held += len(chunk)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        raw, encode = text.encode(), self.vocabulary.encode
        held: list[tuple] = []  # joins and cores that agree: what stood before, ids of the join, core, its ids
        between, word, word_ids = b"", b"", np.zeros(0, np.uint32)
        for chunk in chunks(raw):
            core = self.core(chunk)
            if core is None:
                between += chunk
                continue
            head, ids, first, first_ids, last, last_ids, tail = core
            while True:
                joint = encode(word + between + head + first)
                a, b = len(word_ids), len(joint) - len(first_ids)
                if held and (a > b or not np.array_equal(joint[:a], word_ids)):
                    between, word, word_ids = self.widened(held, between)
                    continue
                break
            if a > b or not np.array_equal(joint[b:], first_ids):
                self.repaired += 1
                between += chunk  # this core is encoded with the next join
                continue
            held.append(((between, word, word_ids), head, joint[a:b], chunk[len(head) : len(chunk) - len(tail)], ids))
            between, word, word_ids = tail, last, last_ids
        while True:
            joint = encode(word + between)
            if not held or np.array_equal(joint[: len(word_ids)], word_ids):
                return np.concatenate([part for _, _, join, _, ids in held for part in (join, ids)] + [joint[len(word_ids) :]])
            between, word, word_ids = self.widened(held, between)

    def widened(self, held: list[tuple], between: bytes):
        """Take the last core back into the text of the join."""
        self.repaired += 1
        (before, word, word_ids), head, _, core, _ = held.pop()
        return before + head + core + between, word, word_ids


def least_hash(text: str | None) -> int:
    """The least hash of a text's chunks, as a signed long."""
    found = min(map(xxhash.xxh64_intdigest, chunks((text or "").encode())))
    return found - (1 << 64) if found >> 63 else found


def colocated(docs: DataFrame, text: str) -> DataFrame:
    """row (the other columns) and text, dealt so that documents that share their least chunk are in one partition, hot ones in several."""
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(None).cast("int").alias("__none")).alias("row"), F.col(text).alias("text"))

    def marked(batch):
        return {n: batch.column(n) for n in ("row", "text")} | {"least": [least_hash(t) for t in batch.column("text").to_pylist()]}

    def mark(batch):
        return {"least": [least_hash(t) for t in batch.column("text").to_pylist()]}

    counts = map_slices(boxed.select("text"), mark, "least long").groupBy("least").count()
    n = docs.count()
    most = max(LEAST_HOT, int(n * HOT_SHARE))
    hot = counts.where(F.col("count") > most).collect()  # fewer than 1 / HOT_SHARE rows
    ways = docs.sparkSession.createDataFrame([(r.least, -(-r["count"] // most)) for r in hot], "least long, ways long")
    new = T.StructType([*boxed.schema.fields, T.StructField("least", T.LongType(), False)])
    dealt = map_slices(boxed, marked, new).join(F.broadcast(ways), "least", "left")
    by = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("ways", F.lit(1)))  # equal rows are dealt too
    return dealt.withColumn("way", by).repartition("least", "way").select("row", "text")


def as_lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    flat = pa.array(np.concatenate(found).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), flat, type=pa.list_(pa.field("element", pa.int32(), False)))


def encode(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False, round_trip: bool = False) -> DataFrame:
    """``docs`` with ``ids``, without the text unless it is asked for.

    ``round_trip``: with the text decoded from the ids in its place, by the same pass: one Python worker and one vocabulary a task instead of two.
    """
    boxed = colocated(docs, text)
    kept = [f for f in boxed.schema.fields if keep_text or round_trip or f.name == "row"]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    held: list[Encoder] = []

    def step(batch):
        if not held:
            held.append(Encoder(path))
        found = [held[0](t) for t in batch.column("text").to_pylist()]
        out = {f.name: batch.column(f.name) for f in kept} | {"ids": as_lists(found)}
        return out | ({"text": [held[0].vocabulary.decode(f.tolist()) for f in found]} if round_trip else {})

    out = map_slices(boxed, step, schema)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text, "ids")]
    return out.select(*own, *([F.col("text").alias(text)] if keep_text or round_trip else []), "ids")


def decode(encoded: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encoded`` with the text that its ids stand for."""
    kept = [f for f in encoded.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])
    held: list[Vocabulary] = []

    def step(batch):
        if not held:
            held.append(Vocabulary(path))
        return {f.name: batch.column(f.name) for f in kept} | {text: [held[0].decode(i) for i in batch.column("ids").to_pylist()]}

    return map_slices(encoded, step, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the text decoded from them."""
    out = encode(docs.select("doc_id", "text"), path, round_trip=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary_path())
