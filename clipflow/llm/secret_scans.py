"""Secret scans: three base rules, and a character convolutional network over every candidate and its surroundings.

A candidate is a maximal run of 16 or more characters of ``A-Za-z0-9+/_.=-``, or one of 6 or more that follows ``:`` or ``=``.
The network sees windows of the run with the text before and after it; a long run has overlapping windows and counts by its
highest. Labelled findings to train on: the corpus's candidates (those that a base rule matches are secrets, the others are not;
at most TRAIN_ROWS findings of each kind are fitted on and EACH windows of one, those with the least hash over the whole corpus),
and a seeded set of SEEDED findings of each kind made by ``labelled_set``, which has secrets that no base rule knows. Both are
always there, so the network is fitted at every size.

A quarter of all findings, by a hash of their characters, is kept apart from the fit. The threshold is the highest EDGE that
finds RECALL of the secrets kept apart, of the corpus's (all of them, from a histogram of their scores) and of the seeded ones alike.

Spans are code point offsets, end exclusive. Base spans stay; a candidate that the network takes for a secret adds a span of its own
unless it lies within one base span, which it then confirms. Null text counts as empty. Repeated rows are scanned alike. An empty
table gives an empty result; extra columns are passed through by ``redact`` and not read by ``scan``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipflow.llm.common import map_slices, staged
from clipflow.llm.common import table as read

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGNED = re.compile(rb"""[:=]["'\x20]*([A-Za-z0-9+/_.=-]{6,})""")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api")
IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
IS_RUN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"))
TRAIN_ROWS, SEEDED, EACH, RECALL = 2000, 1200, 4, 0.98
APART = 4
#: Windows that one row of candidates and one step of the network hold.
PART, STEP = 64, 4096
#: Characters of a candidate in a window, their overlap, and the characters before and after it.
INSIDE, STRIDE, BEFORE, AFTER = 64, 32, 24, 8
WIDTH = BEFORE + INSIDE + AFTER + 2


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true of ``least`` or more."""
    step = np.diff(np.concatenate([[False], member, [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def find(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """In bytes: base spans (start, kind, end), sorted; candidates (start, end, known), sorted. known: 0, or 1 where a base span overlaps, or 2 where one holds it."""
    codes = np.frombuffer(raw, np.uint8)
    base = [(a, 2, b) for a, b in runs(IS_HEX[codes], 24)]
    low = raw.lower()
    if any(n in low for n in NAMES):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    base.sort()
    near = runs(IS_RUN[codes], 16)
    if b":" in raw or b"=" in raw:
        ends = {b for _, b in near}  # a run has one end, so an assigned value that lies in a long run ends with it
        near = sorted([*near, *(m.span(1) for m in ASSIGNED.finditer(raw) if m.end() not in ends)])
    if not (base and near):
        return base, [(a, b, 0) for a, b in near]
    starts, reach = np.array([x for x, _, _ in base]), np.maximum.accumulate([y for _, _, y in base])
    a, b = np.array(near).T
    before = lambda at, side: np.concatenate([[-1], reach])[np.searchsorted(starts, at, side)]
    known = np.where(before(a, "right") >= b, 2, np.where(before(b, "left") > a, 1, 0))  # the furthest end of the spans that begin in time
    return base, list(zip(a.tolist(), b.tolist(), known.tolist(), strict=True))


def windows(raw: bytes, start: int, end: int) -> list[bytes]:
    """The candidate's windows, with marks where it begins and ends."""
    return list(each_window(raw, start, end))


def each_window(raw: bytes, start: int, end: int) -> Iterator[bytes]:
    for at in range(start, max(start, end - INSIDE) + STRIDE, STRIDE) if end - start > INSIDE else [start]:
        stop = min(end, at + INSIDE)
        yield (raw[max(0, at - BEFORE) : at].rjust(BEFORE, b"\0") + b"\2" + raw[at:stop] + b"\3" + raw[stop : stop + AFTER]).ljust(WIDTH, b"\0")


BEGINS, VOWELS, ENDS = "b c ch d f fl g gr h j k kl l m n p pr qu r s sch sh sl st str t th tr v w x y z".split(), "a e i o u ae ai au ea ee ei eu ie oo ou".split(), ["", "", "", *"ck ff ft l ld ll m n nd ng nt p r rd rt s ss st t tt x z".split()]
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
KEYS = "auth pwd passphrase bearer credential client_key private_key signature session pin".split()
FIELDS = "name title color version date author section model language status".split()


def labelled_set(n: int = SEEDED, seed: int = 11) -> list[tuple[bytes, int, int, int]]:
    """``n`` secrets and ``n`` ordinary runs, each in a made text: (text, start, end, label) of the candidate."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda chars, low, high: "".join(pick(chars) for _ in range(int(rng.integers(low, high))))
    shape = lambda w: pick([w, w, w, w.title(), w.upper()])
    word = lambda low=1, high=4: shape("".join(pick(BEGINS) + pick(VOWELS) + pick(ENDS) for _ in range(int(rng.integers(low, high)))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(3, 9))))
    number = lambda high: str(int(rng.integers(high)))
    secrets = (
        lambda: some("0123456789abcdef", 24, 65), lambda: "AKIA" + some(ALNUM[:26] + ALNUM[-10:], 16, 21), lambda: some(ALNUM, 20, 49), lambda: some(ALNUM + "+/", 24, 61) + pick(["", "=", "=="]),
        lambda: some(ALNUM[26:52], 2, 5) + pick("_-") + some(ALNUM, 20, 37), lambda: pick(KEYS) + pick([": ", "=", ' = "', ': "']) + some(ALNUM, 8, 25), lambda: "-".join(some("0123456789abcdef", k, k + 1) for k in (8, 4, 4, 4, 12)),
    )
    plain = (
        lambda: pick("-_./").join(word() for _ in range(int(rng.integers(4, 8)))), lambda: word(6, 11) + "en" * int(rng.integers(1, 4)), lambda: "//" + pick(["www.", ""]) + word(2) + pick([".com/", ".org/", ".de/"]) + pick("/-").join(word() for _ in range(int(rng.integers(2, 6)))), lambda: "/".join(word(2) for _ in range(4)) + "/" + number(10000) + ".html",
        lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}.{rng.integers(10, 60)}", lambda: "-".join(str(int(rng.integers(100, 10000))) for _ in range(4)), lambda: word(3, 5) + "-" + number(10) + "." + number(30) + "." + number(100) + "-release",
        lambda: pick(FIELDS) + pick([": ", " = "]) + pick([word(3, 6), word(3, 6).title(), f"{number(10)}.{number(30)}.{rng.integers(10, 99)}"]), lambda: word(2, 4) + "=" + word(5, 7), lambda: pick("=-_.") * int(rng.integers(16, 60)),
    )
    out = []
    for label, kinds in ((1, secrets), (0, plain)):
        while sum(o[3] == label for o in out) < n:
            head, value = prose() + pick([" ", ". ", "\n"]), pick(kinds)()
            raw, at = (head + value + pick([" ", ". ", '" ', "\n"]) + prose()).encode(), len(head)
            held = [c for c in find(raw)[1] if c[0] < at + len(value) and at < c[1]]
            out += [(raw, a, b, label) for a, b, _ in held[-1:]]
    return out


@dataclass(frozen=True)
class Network:
    """Embedding, convolution of FIELD characters, greatest response, logistic output; then a calibration and a threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def probability(self, found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        x = np.frombuffer(b"".join(found), np.uint8).reshape(-1, WIDTH)
        raw = np.concatenate([forward(self, x[i : i + 256])[0] for i in range(0, len(x), 256)])
        return sigmoid(self.scale * raw + self.shift)


FIELD, DIM, FILTERS = 5, 8, 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


#: Thresholds to choose from: even steps of the logit.
EDGES = sigmoid(np.linspace(-20, 20, 4001))


def forward(net: Network, x: np.ndarray):
    e = net.embed[np.minimum(x, 128)]
    patches = np.lib.stride_tricks.sliding_window_view(e, FIELD, 1).transpose(0, 1, 3, 2).reshape(len(x), -1, FIELD * DIM)
    h = patches @ net.conv + net.bias
    best = h.argmax(1)
    pooled = np.maximum(np.take_along_axis(h, best[:, None], 1)[:, 0], 0)
    return pooled @ net.out[:-1] + net.out[-1], patches, best, pooled


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.3, (129, DIM)), rng.normal(0, 0.2, (FIELD * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS + 1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xb, yb = x[part], y[part]
            z, patches, best, pooled = forward(Network(*p), xb)
            d = (sigmoid(z) - yb) / len(yb)
            g_out = np.append(pooled.T @ d, d.sum())
            d_h = d[:, None] * p[3][:-1] * (pooled > 0)
            chosen = np.take_along_axis(patches, best[:, :, None], 1)  # rows x filters x field
            g_conv = np.einsum("nf,nfk->kf", d_h, chosen)
            d_patch = (d_h[:, :, None] * p[1].T[None]).reshape(len(yb), FILTERS, FIELD, DIM)
            at = best[:, :, None] + np.arange(FIELD)
            g_embed = np.zeros_like(p[0])
            np.add.at(g_embed, np.minimum(np.take_along_axis(xb, at.reshape(len(yb), -1), 1), 128).ravel(), d_patch.reshape(-1, DIM))
            t += 1
            for i, g in enumerate((g_embed, g_conv, d_h.sum(0), g_out)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(*p)


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, recall: float) -> Network:
    """Logistic calibration by Newton steps, then the highest threshold that keeps the recall."""
    z = np.concatenate([forward(net, x[i : i + 256])[0] for i in range(0, len(x), 256)])
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        q = sigmoid(a * z + b)
        w = q * (1 - q) + 1e-9
        grad = np.array([((q - target) * z).sum() + 1e-3 * (a - 1), (q - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    kept = np.sort(sigmoid(a * z + b)[y == 1])
    return Network(net.embed, net.conv, net.bias, net.out, float(a), float(b), float(kept[int((1 - recall) * len(kept))]))


def finding(value: bytes) -> int:
    """A number for the characters of a candidate; findings are dealt by it, so that all windows of one are on one side of the split."""
    return xxhash.xxh64_intdigest(value) >> 1


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """value (number of its characters), place (number of the occurrence), label and up to PART windows; a long run has several rows."""

    def step(batch):
        out: dict[str, list] = {"value": [], "place": [], "label": [], "windows": []}
        for t in batch.column("t").to_pylist():
            raw = (t or "").encode()
            for a, b, known in find(raw)[1]:
                value, place, held = finding(raw[a:b]), xxhash.xxh64_intdigest(raw[max(0, a - BEFORE) : b], a) >> 1, windows(raw, a, b)
                for i in range(0, len(held), PART):
                    for k, v in (("value", value), ("place", place), ("label", int(known > 0)), ("windows", held[i : i + PART])):
                        out[k].append(v)
        return out if out["value"] else None

    return map_slices(docs.select(F.col(text).alias("t")), step, "value long, place long, label int, windows array<binary>", 32)


def as_arrays(rows: list[tuple[list[bytes], int]]) -> tuple[np.ndarray, np.ndarray]:
    held = [(w, label) for ws, label in rows for w in ws[:EACH]]
    return np.frombuffer(b"".join(bytes(w) for w, _ in held), np.uint8).reshape(-1, WIDTH), np.array([float(label) for _, label in held])


def fit(docs: DataFrame, text: str = "text", rows: int = TRAIN_ROWS, recall: float = RECALL) -> Network:
    """A network fitted on a bounded, hash-chosen part of the labelled candidates of all documents and on the seeded set; its threshold covers all secrets kept apart."""
    found = staged(candidates(docs, text), "candidates").withColumn("apart", F.col("value") % APART == 0)
    most = {True: rows // APART, False: rows - rows // APART}
    part: dict[bool, list[tuple[list[bytes], int]]] = {True: [], False: []}
    for label in (0, 1):
        for apart in (True, False):
            of = found.where((F.col("label") == label) & (F.col("apart") == apart)).groupBy("value").agg(F.min_by("windows", "place").alias("windows"))
            chosen = of.orderBy(F.xxhash64("value"), "value").limit(most[apart]).select(F.slice("windows", 1, EACH).alias("windows")).collect()
            part[apart] += [(r.windows, label) for r in chosen]
    seeded: dict[bool, list[tuple[list[bytes], int]]] = {True: [], False: []}
    for raw, a, b, label in labelled_set():
        seeded[finding(raw[a:b]) % APART == 0].append((windows(raw, a, b), label))
    net = calibrate(train(*as_arrays(part[False] + seeded[False])), *as_arrays(part[True] + seeded[True]), recall)
    own = np.bincount(bins(net, [w for w, label in seeded[True] if label]), minlength=len(EDGES))
    return placed(net, found.where("apart AND label = 1"), recall, own)


def bins(net: Network, held: list[list[bytes]]) -> np.ndarray:
    """The highest EDGE that each list of windows reaches by its best."""
    p = net.probability([w for ws in held for w in ws])
    sizes = np.array([len(ws) for ws in held])
    return np.maximum(np.searchsorted(EDGES, np.maximum.reduceat(p, np.cumsum(sizes) - sizes), "right") - 1, 0).astype(np.int32)


def placed(net: Network, secrets: DataFrame, recall: float, *own: np.ndarray) -> Network:
    """``net`` with the highest edge as its threshold that finds the share ``recall`` of ``secrets`` (place and windows), each by its highest window, and of each histogram in ``own``."""

    def step(batch):
        return {"place": batch.column("place"), "bin": bins(net, batch.column("windows").to_pylist())}

    each = map_slices(secrets.select("place", "windows"), step, "place long, bin int", 32).groupBy("place").agg(F.max("bin").alias("bin"))
    counts = np.zeros(len(EDGES))
    for r in each.groupBy("bin").count().collect():  # a row for each edge at most
        counts[r.bin] = r["count"]
    reached = [np.cumsum(c[::-1])[::-1] >= recall * c.sum() for c in (counts, *own) if c.sum()]
    best = min(int(np.flatnonzero(r)[-1]) for r in reached) if reached else len(EDGES) // 2
    return replace(net, threshold=float(EDGES[best]))


def spans_of(texts: list[str | None], net: Network) -> Iterator[tuple[list, list, int]]:
    """Per text: base spans and all spans, as (start, kind, end) in code points, and the number of candidates with a base span that the network confirms."""
    for text in texts:
        raw = (text or "").encode()
        base, near = find(raw)
        spans, confirmed = list(base), 0
        for (a, b, known), p in zip(near, judged(raw, near, net), strict=True):
            if p >= net.threshold:
                confirmed += known > 0
                if known < 2:
                    spans.append((a, 3, b))
        spans.sort()
        if spans and len(raw) != len(text):
            point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            base, spans = ([(int(point[a]), k, int(point[b])) for a, k, b in s] for s in (base, spans))
        yield base, spans, confirmed


def judged(raw: bytes, near: list[tuple[int, int, int]], net: Network) -> np.ndarray:
    """The probability of each candidate, by its highest window; STEP windows are held at a time."""
    best, held, of = np.zeros(len(near)), [], []

    def flush():
        np.maximum.at(best, np.array(of, int), net.probability(held))
        held.clear()
        of.clear()

    for i, (a, b, _) in enumerate(near):
        for w in each_window(raw, a, b):
            held.append(w)
            of.append(i)
            if len(held) >= STEP:
                flush()
    flush()
    return best


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """doc_id, counts by kind, base and all spans as kind:start:end lists, and n_confirmed: base candidates the network finds too."""

    def step(batch):
        got = list(spans_of(batch.column(text).to_pylist(), net))
        counts = {f"n_{k}": [sum(s[1] == i for s in every) for _, every, _ in got] for i, k in enumerate(KINDS)}
        counts["n_confirmed"] = [n for *_, n in got]
        return {"doc_id": batch.column("doc_id"), "base": [written(b) for b, *_ in got], "spans": [written(s) for _, s, _ in got]} | counts

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("n_confirmed", T.LongType()), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    return map_slices(docs.select("doc_id", text), step, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; n_chars, where there is one, follows."""
    net = fit(docs, text)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])

    def step(batch):
        texts = batch.column(text).to_pylist()
        clean = [redacted(t, s, mark) for t, (_, s, _) in zip(texts, spans_of(texts, net), strict=True)]
        return {f.name: batch.column(f.name) for f in schema.fields} | {text: clean}

    out = map_slices(docs, step, schema)
    if "n_chars" in docs.columns:
        changed = F.when(F.contains(text, F.lit(mark)), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, fit(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_network", "n_confirmed")
