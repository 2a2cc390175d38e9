"""SimHash near-duplicates: fingerprints within two differing bits are linked, components of links are groups.

Candidates come from a grid join in the space of segment popcounts. A fingerprint has 32 segments of two bits; its
embedding is their bit counts. One differing bit moves one count by one at most, so the Manhattan distance of embeddings
is a lower bound of the Hamming distance. Two differing bits touch two of GROUPS coordinate groups at most: points within
distance 2 share a grid cell in at least one projection that leaves two groups out. Pairs of a cell are held against the
Manhattan bound and then compared exactly.

A cell with more than CELL points is not paired: each of its points names itself and the 64 fingerprints one bit away, and
points that name the same one are linked to the least of them. That finds exactly the pairs within two bits and emits 65
rows a point, so a large group of near copies costs in proportion to its size.

``deduplicate`` links by another rule, that of near copies: texts whose sets of 5-word shingles have a Jaccard similarity of
0.8 or more. Such texts differ in 2 to 20 bits or so, where no grid of popcounts tells them from others, so the pairs within two bits are
only some of its candidates; the others share one of BANDS bands of ROWS least hashes of their shingles. A pair at the least
similarity is missed with a chance of 0.00065, whatever the size of the table. Sketches sift the candidates, and what is left is compared
shingle by shingle. In a cell of more than CROWDED texts each is first compared with the least; then all that are not yet in one group
are held against each other, block by block: sketches name the texts with a likely partner, and the shingles of those are compared (``across``).

Only distinct fingerprints (``deduplicate``: distinct texts) take part, so exact copies, and all texts without words (fingerprint zero), are one point.
Null text: no words. Null doc_id: kept as a row; it is never a component's id unless the whole component has none.
Repeated rows stay rows. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices, staged
from clipflow.llm.common import table as read
from clipflow.llm.graph import components, release

SHINGLE, SEED, BITS_APART = 3, 42, 2
SEGMENTS, GROUPS, CELL = 32, 5, 64
#: Fingerprints of more than a share 1 / MOST_HOT of all rows (and than LEAST_HOT) are joined by broadcast.
MOST_HOT, LEAST_HOT = 1000, 500
#: Near copies: words of a shingle, least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Bands of ROWS least hashes each: a pair of SIMILARITY exactly shares none with a chance of (1 - 0.8 ** 8) ** 40 = 0.00065.
BANDS, ROWS = 40, 8
#: A cell of more texts than this is not paired at once; then its rows are compared in blocks of about BLOCK texts or LOAD shingles, whichever are fewer.
CROWDED, BLOCK, LOAD = 16, 1024, 1 << 17
#: Bins of a sketch, and most that differ: 24 expected at SIMILARITY, with a deviation of 4.4.
BINS, MOST_BINS = 128, 42
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = np.random.default_rng(SEED + 1).integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: Shingles that are multiplied by all factors at a time; bounds the memory of a long text.
PART = 1024
BIT_TABLE = (np.arange(256)[:, None] >> np.arange(8)) & 1
LANES = np.arange(8) * 256


def shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Each bit 1 if set in over half the hashes, as a signed long."""
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + LANES).ravel(), minlength=2048).reshape(8, 256) @ BIT_TABLE
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame, text: str = "text", near: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), content, a 64-bit hash of the text, and, if asked for, size, bands and sketch of its shingles."""

    def step(batch):
        texts = batch.column("t").to_pylist()
        found = {"doc_id": batch.column("doc_id"), "content": batch.column("content"), "fp": np.array([fingerprint(t) for t in texts], np.int64)}
        if near:
            longs, sets = pa.list_(pa.int64()), [shingle_set(t) for t in texts]
            found |= {"size": np.array([len(s) for s in sets], np.int64), "bands": pa.array(map(bands, sets), longs), "sketch": pa.array(map(sketch, sets), longs)}
        return found

    more = [T.StructField("size", T.LongType()), *(T.StructField(name, T.ArrayType(T.LongType())) for name in ("bands", "sketch"))] if near else []
    schema = T.StructType([docs.schema["doc_id"], T.StructField("content", T.LongType()), T.StructField("fp", T.LongType(), False), *more])
    return map_slices(docs.select("doc_id", F.xxhash64(text).alias("content"), F.col(text).alias("t")), step, schema)


def group_masks(groups: int = GROUPS) -> list[int]:
    """For each choice of two coordinate groups left out, the bits of the segments that stay, as signed longs."""
    parts = np.array_split(np.arange(SEGMENTS), groups)
    out = []
    for left_out in combinations(range(groups), BITS_APART):
        mask = sum(3 << (2 * int(s)) for g in range(groups) if g not in left_out for s in parts[g])
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def embed(fp: str = "fp"):
    """The 32 segment counts, each in thermometer form (0: 00, 1: 01, 2: 11), so that bit_count(x ^ y) is their Manhattan distance."""
    odd = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    some, both = F.col(fp).bitwiseOR(up).bitwiseAND(odd), F.col(fp).bitwiseAND(up).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def links(points: DataFrame, groups: int = GROUPS, most: int = CELL) -> DataFrame:
    """points: distinct longs fp. Returns a < b such that components of these links are those of all pairs within two bits."""
    cells = [F.struct(F.lit(i).alias("grid"), F.col("at").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(group_masks(groups))]
    placed = points.select("fp", embed().alias("at")).select("fp", "at", F.inline(F.array(*cells)))
    full = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(placed.join(full, ["grid", "cell"]), "cells")
    few = shared.where(F.col("n") <= most).select("grid", "cell", "fp", "at")
    other = few.select("grid", "cell", F.col("fp").alias("fp2"), F.col("at").alias("at2"))
    near = (F.bit_count(F.col("at").bitwiseXOR(F.col("at2"))) <= BITS_APART) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= BITS_APART)
    same = [few["grid"] == other["grid"], few["cell"] == other["cell"], F.col("fp") < F.col("fp2"), near]
    pairs = few.join(other, same).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    crowded = shared.where(F.col("n") > most).select("fp").distinct()
    flips = F.array(F.lit(0), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)))
    named = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("name"))
    met = named.groupBy("name").agg(F.sort_array(F.collect_set("fp")).alias("all")).where("size(all) > 1")  # 65 at most
    stars = met.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
    return pairs.union(stars).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """prints: as ``fingerprints`` returns it, staged. Returns fp, its rows, and first: the component's least (no_id, doc_id, content)."""
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first"), F.count("*").alias("rows"))
    points = staged(least, "points")
    roots = components(links(points.select("fp")))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.select("fp", "root", "rows").join(first, "root").select("fp", "first", "rows")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = staged(fingerprints(docs, text), "prints")
    of, n = staged(grouped(prints), "components"), prints.count()
    hot = F.broadcast(of.where(F.col("rows") > max(LEAST_HOT, n // MOST_HOT)).select("fp", "first"))  # fewer than MOST_HOT rows
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(of.select("fp", "first"), "fp")
    out = prints.join(hot, "fp").unionByName(rest)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def by_cell(rows: DataFrame, cells: DataFrame, hot: int) -> DataFrame:
    """rows and cells: both with cell and n, its points. Cells of more than ``hot`` points, MOST_HOT a grid at most, are joined by broadcast."""
    busy = rows.where(F.col("n") > hot).join(F.broadcast(cells.where(F.col("n") > hot).drop("n")), "cell")
    return busy.unionByName(rows.where(F.col("n") <= hot).join(cells.where(F.col("n") <= hot).drop("n"), "cell"))


def band_cells(points: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """points: content, bands, ``n`` of them. Returns the pairs of small cells (x, y), and the rows of crowded cells (content, cell, n, least).

    A cell is a band's value. Cells of very many texts, fewer than MOST_HOT a band, are counted first and not gathered."""
    hot = max(LEAST_HOT, n // MOST_HOT)
    placed = points.select("content", F.explode("bands").alias("cell"))
    busy = F.broadcast(staged(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("content").alias("least")).where(F.col("n") > hot), "busy"))
    cell = Window.partitionBy("cell")
    rest = placed.join(busy.select("cell"), "cell", "left_anti").select("content", "cell", F.count("*").over(cell).alias("n"), F.min("content").over(cell).alias("least"))
    rest = staged(rest.where("n > 1"), "cells")
    few = rest.where(F.col("n") <= CROWDED).groupBy("cell").agg(F.collect_list("content").alias("all"))
    pairs = few.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: y > F.col("x"))).alias("y"))
    crowded = rest.where(F.col("n") > CROWDED).unionByName(placed.join(busy, "cell").select("content", "cell", "n", "least"))
    return pairs, staged(crowded, "crowded")


def candidates(points: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """points: content, fp, bands, staged. Returns a < b (contents), and the rows of crowded cells, of which only those with the least text are among the pairs."""
    pairs, crowded = band_cells(points, n)
    stars = crowded.select(F.col("least").alias("x"), F.col("content").alias("y")).where("x <> y")
    least = points.groupBy("fp").agg(F.min("content").alias("content"))
    two = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("content").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("content").alias("y")), "b")
    same = points.join(least.select("fp", F.col("content").alias("x")), "fp").where(F.col("content") != F.col("x")).select("x", F.col("content").alias("y"))
    found = pairs.union(stars).union(two.select("x", "y")).union(same)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), crowded


def kind(size):
    """Texts whose kinds are more than one apart differ so much in size that they are less than SIMILARITY alike."""
    return F.floor(F.log(1 / SIMILARITY, size))


def blocks(n, kind):
    """Into how many blocks the texts of a kind go in a cell of ``n`` texts."""
    return F.ceil(n * F.greatest(F.lit(1 / BLOCK), F.pow(F.lit(1 / SIMILARITY), kind + 1) / LOAD))


def across(crowded: DataFrame, roots: DataFrame, points: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """points: content, size, bands, sketch. Returns pairs a < b that are SIMILARITY or more alike, which join all components so far that likely pairs of crowded cells join.

    A cell whose texts are one component, as in a large group of copies, has none. In others the texts outside the largest
    component are held against all, block by block. No pair is written: the first pass keeps the texts that have a likely partner in a
    pair of blocks, the second compares their shingles there and keeps the pairs that join two components.
    """
    hot = max(LEAST_HOT, n // MOST_HOT)
    own = crowded.select("content", "cell", "n").join(roots.select(F.col("node").alias("content"), "root"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    own = staged(own, "owned")
    sizes = own.groupBy("cell", "n", "root").agg(F.count("*").alias("held"))
    mixed = sizes.groupBy("cell", "n").agg(F.max(F.struct("held", "root")).alias("most")).where(F.col("most.held") < F.col("n"))
    rows = by_cell(own, mixed, hot).join(points.withColumn("kind", kind(F.col("size"))), "content")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("content"), blocks(F.col("n"), F.col("kind")))).withColumn("p", F.struct("content", "root", "sketch", "bands"))
    rows = staged(rows.select("cell", "n", F.col("most.root").alias("most"), "kind", "block", "p"), "mixed")
    held = rows.groupBy("cell", "kind", "block").agg(F.collect_list("p").alias("held"))
    asking = rows.where(F.col("p.root") != F.col("most")).groupBy("cell", "n", "most", F.col("kind").alias("of"), F.col("block").alias("from")).agg(F.collect_list("p").alias("asking"))
    asking = asking.withColumn("kind", F.explode(F.array(*(F.col("of") + i for i in (-1, 0, 1)))))
    met = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("n"), F.col("kind")) - 1))).join(held, ["cell", "kind", "block"])
    tile = ["cell", "of", "from", "kind", "block"]
    marked = map_slices(met.select(*tile, "most", "asking", "held"), likely_apart, "".join(f"`{c}` long, " for c in tile) + "asks boolean, content long, root long", rows=1)
    p = F.struct("content", "root", "shingles")
    full = staged(marked, "marked").join(sets, "content").groupBy(*tile).agg(F.collect_list(F.when(F.col("asks"), p)).alias("asking"), F.collect_list(F.when(~F.col("asks"), p)).alias("held"))
    return map_slices(full.select("asking", "held"), alike_apart, "a long, b long", rows=1).distinct()


def likely_apart(batch: pa.RecordBatch) -> dict:
    """For one block of asking texts against one of held: the texts with a likely partner of another component.

    A pair counts in the first cell that its bands share alone, and once if both ask."""
    cell, most = (batch.column(name)[0].as_py() for name in ("cell", "most"))
    content, root, lines, cells = [], [], [], []
    for name in ("asking", "held"):
        texts = batch.column(name).flatten()  # the one row's list; ``values`` would be those of all rows
        ids, roots, sketches, all_bands = texts.flatten()
        content.append(ids.to_numpy()), root.append(roots.to_numpy())
        lines.append(sketches.flatten().to_numpy().reshape(len(texts), -1).view(np.uint64))
        cells.append(all_bands.flatten().to_numpy().reshape(len(texts), -1))
    marks = [np.zeros(len(ids), bool) for ids in content]
    for at in range(0, len(content[0]), 64):
        x = lines[0][at : at + 64, None] ^ lines[1][None]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        bins = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(2, dtype=np.int64)
        once = (root[1] == most) | (content[0][at : at + 64, None] < content[1])
        i, j = np.nonzero((bins <= MOST_BINS) & once & (root[0][at : at + 64, None] != root[1]))
        first = (cells[0][at + i] == cells[1][j]).argmax(1)
        here = cells[1][j, first] == cell
        marks[0][at + i[here]] = marks[1][j[here]] = True
    count = marks[0].sum() + marks[1].sum()
    tile = {name: np.full(count, batch.column(name)[0].as_py()) for name in ("cell", "of", "from", "kind", "block")}
    both = lambda of: np.concatenate([values[mark] for values, mark in zip(of, marks, strict=True)])
    return tile | {"asks": np.arange(count) < marks[0].sum(), "content": both(content), "root": both(root)}


def alike_apart(batch: pa.RecordBatch) -> dict:
    """For asking against held texts: pairs that are SIMILARITY or more alike, those alone that join two components."""
    content, root, sizes, hashes = [], [], [], []
    for name in ("asking", "held"):
        ids, roots, shingles = batch.column(name).flatten().flatten()
        content.append(ids.to_numpy()), root.append(roots.to_numpy().copy())
        sizes.append(shingles.value_lengths().to_numpy().astype(np.int64)), hashes.append(shingles.flatten().to_numpy())
    _, number = np.unique(np.concatenate(hashes), return_inverse=True)
    asking, held = np.split(number, [len(hashes[0])])
    starts, seen = np.cumsum(sizes[1]) - sizes[1], np.zeros(len(number), bool)
    a, b = [], []
    for i, own in enumerate(np.split(asking, np.cumsum(sizes[0])[:-1])):
        if (root[1] == root[0][i]).all():
            continue
        seen[own] = True
        shared = np.add.reduceat(seen[held], starts, dtype=np.int64)
        seen[own] = False
        for j in np.flatnonzero((shared >= SIMILARITY * (len(own) + sizes[1] - shared)) & (root[1] != root[0][i])):
            if (old := root[1][j]) != (new := root[0][i]):
                a.append(min(content[0][i], content[1][j])), b.append(max(content[0][i], content[1][j]))
                for of in root:
                    of[of == old] = new
    return {"a": np.array(a, np.int64), "b": np.array(b, np.int64)}


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of WORDS words (fewer words: the whole sequence; none: one for all such texts)."""
    words = (text or "").encode().lower().split()
    shingles = {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BINS values of four bits, packed in longs: of each range of hashes the lowest four bits of its least hash (no hash: 0)."""
    hashes = np.sort(shingles.view(np.uint64))
    bins, at = np.unique((hashes >> np.uint64(57)).astype(np.int64), return_index=True)
    four = np.zeros(BINS, np.uint8)
    four[bins] = (hashes[at] & np.uint64(15)).astype(np.uint8)
    return (four[::2] | four[1::2] << 4).view(np.int64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One number a band of ROWS least hashes; two sets share a band's with the chance of their similarity to the power of ROWS."""
    hashes, least = shingles.view(np.uint64), np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), PART):
        np.minimum(least, np.multiply.outer(FACTORS, hashes[at : at + PART]).min(1), out=least)
    mixed = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(31))) * MIX).sum(1)
    return ((mixed ^ (mixed >> np.uint64(29))) * MIX[:, 0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts: content, t. Returns content and its shingles."""

    def step(batch):
        return {"content": batch.column("content"), "shingles": pa.array([shingle_set(t) for t in batch.column("t").to_pylist()], pa.list_(pa.int64()))}

    return map_slices(texts, step, "content long, shingles array<long>")


def differing(a, b):
    """In how many bins two sketches differ."""
    total = F.lit(0)
    for i in range(BINS // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return total


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sketches differ in MOST_BINS bins or fewer, with bins, their number.

    A bin of two sets that are SIMILARITY alike or more differs with a chance of 1 - SIMILARITY at most: fewer than one such pair in 10,000 is lost.
    """
    left, right = (sets.select(F.col("content").alias(end), F.col("sketch").alias(f"k{end}")) for end in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", differing(F.col("ka"), F.col("kb")).alias("bins")).where(F.col("bins") <= MOST_BINS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose shingle sets are SIMILARITY or more alike."""
    left, right = (sets.select(F.col("content").alias(end), F.col("shingles").alias(f"s{end}")) for end in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") >= SIMILARITY * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def nearest(pairs: DataFrame) -> DataFrame:
    """For each end of the pairs a, b, bins the one with the fewest bins."""
    best = lambda end: pairs.groupBy(end).agg(F.min(F.struct("bins", F.xxhash64("a", "b"), "a", "b")).alias("p")).select("p.a", "p.b")
    return best("a").union(best("b")).distinct()


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b whose ends ``roots`` leaves in two components."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    return both.select(pairs.columns)


def settled(open_pairs: DataFrame, sets: DataFrame, n: int, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Verify ``open_pairs`` as far as they matter: (pairs verified so far, their components). n: the distinct texts of the table.

    In a round each text is compared with its nearest by sketch; then pairs inside a component need no comparison. When the pairs are
    not many more than the texts among them, or half as many as those of the table, or after ``rounds``, all that still lie between
    components are compared at once: a comparison costs less than finding the components of a further round.
    """
    sure = roots = None
    for k in range(rounds):
        left = open_pairs.count()
        last = left <= n // 2 or k == rounds - 1
        best = None if last else staged(nearest(open_pairs), "nearest")
        last = last or left <= 2 * best.count()
        found = verified(open_pairs if last else best, sets)
        sure = staged(found if sure is None else sure.union(found), "sure")
        roots = staged(components(sure), "groups")
        release(roots)
        if last:
            break
        open_pairs = staged(between(open_pairs.join(best, ["a", "b"], "left_anti"), roots), "open")
    return sure, roots


def named(doc_id, content):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), content.cast("string"))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id (ties: least content hash); repeats of it go.

    Each text is first compared with its nearest candidates, by sketch; what lies in one group then needs no further comparison
    (``settled``). So with the pairs of small cells and of each crowded cell's least text; then all groups that share a crowded cell
    are held against each other (``across``).
    """
    prints = staged(fingerprints(docs, text, near=True), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    contents = staged(prints.groupBy("content").agg(F.min(first).alias("first"), F.min("fp").alias("fp"), *(F.any_value(c).alias(c) for c in ("size", "bands", "sketch"))), "contents")
    n, sketches = contents.count(), contents.select("content", "sketch")
    close, crowded = candidates(contents.select("content", "fp", "bands"), n)
    open_pairs = staged(likely(close, sketches), "likely")
    release(open_pairs)

    # doc_id and content together name a text, so that copies of one text are not dealt to one task
    boxed = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"), F.xxhash64(text).alias("content"), named(F.col("doc_id"), F.xxhash64(text)).alias("__name"))
    needed = open_pairs.select(F.col("a").alias("content")).union(open_pairs.select("b")).union(crowded.select("content")).distinct()
    names = contents.join(needed, "content", "left_semi").select(named(F.col("first.doc_id"), F.col("content")).alias("__name"))
    texts = boxed.select("content", "t", "__name").join(names, "__name", "left_semi").dropDuplicates(["__name"])
    sets = staged(shingle_sets(texts.select("content", "t")), "shingles")
    sure, roots = settled(open_pairs, sets, n)
    joined = across(crowded, roots, contents.select("content", "size", "bands", "sketch"), sets, n)
    all_roots = staged(components(sure.union(joined)), "groups")
    release(all_roots)
    placed = contents.join(all_roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    stays = placed.groupBy("root").agg(F.min("first").alias("first")).select(named(F.col("first.doc_id"), F.col("first.content")).alias("__name"))
    return boxed.select("row", "__name").join(stays, "__name", "left_semi").dropDuplicates(["__name"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
