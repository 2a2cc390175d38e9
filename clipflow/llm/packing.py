"""Best-fit packing of token sequences by a linear grouping scheme.

A document's ids, with an end id, are one piece; a longer document is cut into full pieces and a shorter first one. All that the
packing looks at is how many pieces there are of each length: at most CAPACITY numbers, whatever the corpus holds. From them the
driver makes a plan:

1. Lengths above CAPACITY / SMALL are sorted and cut into GROUPS groups of equal cardinality; each group's lengths are rounded up
   to its greatest. Groups that round to the same length are one.
2. Configurations, multisets of rounded lengths that fit a sequence, are generated by columns (linear program by the simplex
   method, priced by a knapsack over lengths) and used as often as the program says, in whole numbers.
3. Actual pieces take the places: a place takes the longest pieces that are left and not above its rounded length, the last place
   of a sequence the longest that its free space holds. So the sequences of a configuration fall into kinds of equal content, about
   as many as there are places and lengths.
4. What is left, pieces that no configuration took (see COVERED) and then the small ones, longest first, goes where the least space that
   suffices is free; that is done for all sequences of a kind at once.

A piece finds its place from its number among the pieces of its length; those numbers are counted in blocks by hash, so one
length may have any share of all pieces. Ids are encoded once and need not leave their task.

Null text: no ids but the end id. Null doc_ids and repeated rows are documents of their own. An empty table gives an empty
result. Other columns are passed through; a column named like an output is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.bpe import Vocabulary, vocabulary_path
from clipflow.llm.common import map_slices, staged
from clipflow.llm.common import table as read

CAPACITY, END_ID, SMALL, GROUPS = 1024, 2, 8, 80
#: Configurations are used for this share of the pieces they cover. Places take pieces a little longer than the average of their
#: group, so what is left is shorter and fits the space that rounding leaves: fewer sequences than with the whole.
COVERED = 0.9
#: Pieces that one window of the numbering is meant to hold, and the least number of windows a length is dealt over.
BLOCK_ROWS, LEAST_BLOCKS = 50_000, 64
OUT = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of each piece of a document of ``n`` ids; only the first may be short of ``capacity``."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, text: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """row (the other columns), piece, start, length, ids_crc32 and, if asked for, ids."""
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(None).cast("int").alias("__none")).alias("row"), F.col(f"`{text}`").alias("text"))
    ids_type = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if keep_ids else []
    schema = T.StructType([boxed.schema["row"], T.StructField("piece", T.IntegerType(), False), *(T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32")), *ids_type])
    held: list[Vocabulary] = []

    def step(batch):
        if not held:
            held.append(Vocabulary(path))
        rows, number, starts, lengths, sums, kept = [], [], [], [], [], []
        for i, value in enumerate(batch.column("text").to_pylist()):
            ids = np.append(held[0].encode((value or "").encode()).astype("<u4"), np.array(end_id, "<u4"))
            for k, (at, n) in enumerate(cut(len(ids), capacity)):
                rows.append(i), number.append(k), starts.append(at), lengths.append(n)
                sums.append(zlib.crc32(ids[at : at + n].tobytes()))
                if keep_ids:
                    kept.append(ids[at : at + n].astype(np.int32))
        out = {"row": batch.column("row").take(pa.array(rows)), "piece": number, "start": starts, "length": lengths, "ids_crc32": sums}
        return out | ({"ids": kept} if keep_ids else {})

    return map_slices(boxed, step, schema)


def groups_of(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int]]:
    """Equal-cardinality groups of the lengths above ``least``, longest first: rounded length and number of pieces."""
    held = [(n, int(counts[n])) for n in range(len(counts) - 1, least, -1) if counts[n]]
    size, room, out = -(-sum(c for _, c in held) // groups), 0, {}
    top = 0
    for n, c in held:
        while c:
            if not room:
                room, top = size, n
            part = min(c, room)
            out[top] = out.get(top, 0) + part
            c, room = c - part, room - part
    return list(out.items())


def priced(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest worth: how often each size is taken. Knapsack over lengths, one more item a round."""
    rounds = capacity // int(sizes.min())
    best, taken = np.zeros(capacity + 1), []
    space = np.arange(capacity + 1)[:, None] - sizes
    for _ in range(rounds):
        value = np.where(space >= 0, best[np.maximum(space, 0)] + worth, -np.inf)
        choice = value.argmax(1)
        gain = value[np.arange(capacity + 1), choice]
        choice[gain <= best + 1e-12] = -1
        best = np.maximum(gain, best)
        taken.append(choice)
        if (choice < 0).all():
            break
    out, at = np.zeros(len(sizes), int), capacity
    for choice in reversed(taken):
        if choice[at] >= 0:
            out[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, most_rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used: few sequences that cover ``demand``, by column generation.

    Ends when no configuration's worth at the present prices exceeds one by more than ``gap``: the sum is then within that share of the least.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse, used = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for turn in range(most_rounds):
        prices = inverse.sum(0)
        column = priced(sizes, prices, capacity).astype(float)
        if column @ prices <= 1 + gap:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        if turn % 100 == 99:  # rounding errors don't build up
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ demand, 0)
    return basis.astype(int).reshape(k, k), used


def whole(config: np.ndarray, used: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Whole numbers of uses: the whole part, then one more in order of the fraction, while the pieces are there."""
    times = np.floor(used + 1e-9).astype(int)
    left = demand - config @ times
    while (left < 0).any():  # an excess by rounding
        j = int(np.flatnonzero((config[left < 0].sum(0) > 0) & (times > 0))[0])
        times[j] -= 1
        left = demand - config @ times
    for j in np.argsort(-(used - times)):
        if config[:, j].any() and (left >= config[:, j]).all():
            times[j] += 1
            left = left - config[:, j]
    return times


class Plan:
    """Kinds of sequences: how many, free space, and what they hold as (length, number) pairs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.kinds: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]  # by free space

    def add(self, times: int, free: int, content: list[tuple[int, int]]):
        self.kinds[free].append((times, content))

    def substitute(self, times: int, sizes: list[int], left: np.ndarray):
        """``times`` sequences of one configuration, filled from ``left``, the numbers of pieces by length. A place takes the longest piece
        that is left and not above its rounded length; the last place, the longest that the space really free holds."""
        places = [taken(left, size, times) for size in sizes[:-1]]
        times = min([times, *(sum(c for _, c in p) for p in places)])
        at = [0] * len(places)
        while times:
            step = min([times, *(p[i][1] for p, i in zip(places, at, strict=True))])
            lengths = [p[i][0] for p, i in zip(places, at, strict=True)]
            free = self.capacity - sum(lengths)
            for n, c in [*taken(left, free, step), (0, step)]:
                c = min(c, step)
                if c:
                    content = sorted([*lengths, n] if n else lengths, reverse=True)
                    self.add(c, free - n, [(m, content.count(m)) for m in dict.fromkeys(content)])
                    step, times = step - c, times - c
                    for q, (p, i) in enumerate(zip(places, at, strict=True)):
                        p[i] = (p[i][0], p[i][1] - c)
            at = [i + (i + 1 < len(p) and not p[i][1]) for p, i in zip(places, at, strict=True)]
        for n, c in (pair for p in places for pair in p):  # pieces whose other places stayed empty
            left[n] += c

    def best_fit(self, length: int, number: int):
        """Put ``number`` pieces of ``length`` where the least space that suffices is free; open new sequences if there is none."""
        for free in range(length, self.capacity):
            kinds = self.kinds[free]
            while kinds and number:
                times, content = kinds.pop()
                each = free // length
                full = min(times, number // each)
                if full:
                    self.add(full, free - each * length, [*content, (length, each)])
                    times, number = times - full, number - full * each
                if times and number and number < each:
                    self.add(1, free - number * length, [*content, (length, number)])
                    times, number = times - 1, 0
                if times:
                    kinds.append((times, content))
            if not number:
                return
        each = self.capacity // length
        if number // each:
            self.add(number // each, self.capacity - each * length, [(length, each)])
        if number % each:
            self.add(1, self.capacity - number % each * length, [(length, number % each)])

    def entries(self) -> tuple[np.ndarray, int]:
        """One row for the pieces of a length in a kind: length, first number among that length, pieces a sequence, first sequence, offset.

        Sorted by length and first number. Also how many sequences there are."""
        cursor, base, out = np.zeros(self.capacity + 1, np.int64), 0, []
        for kinds in self.kinds:
            for times, content in kinds:
                offset = 0
                for length, each in content:
                    out.append((length, int(cursor[length]), each, base, offset))
                    cursor[length] += times * each
                    offset += length * each
                base += times
        return np.array(sorted(out), np.int64).reshape(-1, 5), base


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, covered: float = COVERED) -> Plan:
    """``counts[n]``: how many pieces of length n there are, n up to ``capacity``."""
    out, left = Plan(capacity), counts.astype(np.int64).copy()
    if left[capacity]:
        out.add(int(left[capacity]), 0, [(capacity, 1)])
        left[capacity] = 0
    held = groups_of(left, capacity // SMALL, groups)
    if held:
        sizes = np.array([n for n, _ in held])
        demand = np.array([c for _, c in held])
        config, used = configurations(sizes, demand, capacity)
        times = whole(config, used * covered, demand)
        for j in sorted(np.flatnonzero(times), key=lambda j: -times[j]):
            out.substitute(int(times[j]), [int(sizes[g]) for g in np.flatnonzero(config[:, j]) for _ in range(config[g, j])], left)
    for n in range(capacity - 1, 0, -1):
        if left[n]:
            out.best_fit(n, int(left[n]))
    return out


def taken(left: np.ndarray, most: int, number: int) -> list[tuple[int, int]]:
    """Take up to ``number`` pieces from ``left``, longest first, none above ``most``: (length, number) pairs."""
    out = []
    for n in (np.flatnonzero(left[: most + 1])[::-1]).tolist():
        if not number:
            break
        part = min(int(left[n]), number)
        out.append((n, part))
        left[n] -= part
        number -= part
    return out


def numbered(held: DataFrame, n_rows: int) -> DataFrame:
    """``held`` with number: 0, 1, ... among the pieces of a length, counted in blocks that start where the last ended."""
    blocks = max(LEAST_BLOCKS, -(-n_rows // BLOCK_ROWS))
    rows = held.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("length", "block").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "block", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(W.partitionBy("length", "block").orderBy("rid"))
    return rows.withColumn("own", own.cast("long") - 1).join(starts, ["length", "block"]).withColumn("number", F.col("own") + F.col("first")).drop("own", "first", "block")


def placed(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """sequence_id and offset of each piece from its length and number. ``entries`` is bounded by the lengths there are, not by the pieces."""
    key = (entries[:, 0] << 48) + entries[:, 1]
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def step(batch):
        length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
        _, first, each, base, offset = entries[np.searchsorted(key, (length << 48) + number, "right") - 1].T
        within = number - first
        return {n: batch.column(n) for n in batch.schema.names} | {"sequence_id": base + within // each, "offset": offset + within % each * length}

    return map_slices(rows, step, schema, rows=1 << 14)


def pack(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Per piece: the other columns of its document, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    held = staged(pieces(docs, path, text, capacity, end_id, keep_ids).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    found = held.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    entries, _ = plan(counts, capacity, groups).entries()
    out = placed(numbered(held, int(counts.sum())), entries)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text, *OUT)]
    return out.select(*own, *(c for c in OUT if c in out.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
