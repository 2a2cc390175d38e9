"""WARC: a deterministic sharded writer and a reader.

Pages are cut into shards by ranges of page_id that hold about ``shard_bytes`` of payload each: ids are sorted by range with running
sums of their bytes, so dense, sparse and outlying ids give even shards. An id whose own pages exceed a shard is split by digest.
A task writes one shard: sorted by page_id, record by record as gzip members; a file ends when its compressed size reaches
``roll_bytes``. At most MOST shards are made (larger ones for more bytes), so their edges are a bounded one-row table. Headers
and digests are made anew from the payload, so the same table gives the same files.

Each task writes under a temporary name of its own attempt and reports it. Only what the finished job reports is the manifest;
a second job renames the files of the manifest to their final names (a file that is under neither name is an error), so a lost or
repeated attempt leaves no trace in the result, and the manifest is stored beside the files. A folder that holds archives is refused.
The reader goes by the manifest alone: it opens the files named there, checks their size and sha256 and fails on a missing one.

Of pages with equal payloads the one with the largest page_id is the response and the others are revisits of it. If that page_id
is repeated with that payload, the first is the response. The html is shuffled once: the few columns that say which pages
revisit what travel with it as rows of their own.

Null html is an empty payload; a null url has no target header; null page_ids come first and have no id header. Control characters
and blanks in urls are percent-encoded. An empty table gives no files and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipflow.llm.common import map_slices, shared_dir, staged
from clipflow.llm.common import table as read

SHARD_BYTES, ROLL_BYTES = 24 << 20, 8 << 20
#: Shards at most, edges in one inner array, and the ways a hot payload is dealt to learn who answers for it.
MOST, INNER, SALT = 1 << 16, 1 << 8, 16
NULL_ID = -(1 << 63)
#: The tables have no time of capture; every record carries this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def member(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; headers without a value are left out."""
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *((k, v) for k, v in headers if v is not None), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    target = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    if not revisit:
        return member("response", own, http + payload)
    return member("revisit", [*own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)], http)


def edges(keyed: DataFrame, shard_bytes: int) -> tuple[list[tuple[int, int, int]], int]:
    """(first place, shard, ways) of each range of page_ids, in order, and the number of shards. keyed: place (page_id, nulls as NULL_ID), n (bytes)."""
    ids = keyed.groupBy("place").agg((F.sum("n") + F.count("*")).alias("n"))
    sorted_ = staged(ids.repartitionByRange("place").sortWithinPartitions("place").withColumn("part", F.spark_partition_id()), "ids")
    sums = sorted_.groupBy("part").agg(F.sum("n").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")  # a row for each partition of the range sort
    sums = staged(sums.select("part", "n", before), "sums")
    total = sums.agg(F.sum("n")).first()[0]
    if not total:
        return [], 1
    shards = min(MOST, max(1, -(-total // shard_bytes)))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    done = sorted_.drop("first").withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(sums.select("part", "before")), "part")
    at = done.select("place", F.floor((F.col("inside") + F.col("before")).cast("double") * shards / F.lit(float(total))).cast("long").alias("at"))
    starts = sorted((r.place, r.at) for r in at.groupBy("at").agg(F.min("place").alias("place")).collect())  # MOST rows at most
    out, next_shard = [], 0
    for (place, own), (_, then) in zip(starts, [*starts[1:], (0, starts[-1][1] + 1)], strict=True):
        ways = then - own if then - own > 1 else 1  # the ids of a range fill one shard; one id that fills more has its ways
        out.append((place, next_shard, ways))
        next_shard += ways
    return out, next_shard


def with_shard(rows: DataFrame, keyed: DataFrame, shard_bytes: int, digest) -> tuple[DataFrame, int]:
    """``rows`` with the shard of their place, and the number of shards. digest: the payload's, as hex digits."""
    found, shards = edges(keyed, shard_bytes)
    if not found:
        return rows.withColumn("shard", F.lit(0)), 1
    blocks = [found[i : i + INNER] for i in range(0, len(found), INNER)]
    held = "blocks array<struct<first:long,edges:array<struct<place:long,shard:int,ways:int>>>>"
    table = F.broadcast(rows.sparkSession.createDataFrame([([(b[0][0], b) for b in blocks],)], held))  # one row, MOST edges at most
    last = lambda xs, at: F.element_at(xs, F.greatest(F.size(F.filter(xs, lambda e: at(e) <= F.col("place"))), F.lit(1)))
    placed = rows.crossJoin(table).withColumn("e", last(last(F.col("blocks"), lambda b: b["first"])["edges"], lambda e: e["place"])).drop("blocks")
    way = F.when(F.col("e.ways") > 1, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("e.ways")).otherwise(0)
    return placed.withColumn("shard", (F.col("e.shard") + way).cast("int")).drop("e"), shards


def write(pages: DataFrame, out: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to the new or empty folder ``out``; returns the manifest."""
    target, root = fs.FileSystem.from_uri(out)
    if any(not f.base_name.startswith(".") for f in target.get_file_info(fs.FileSelector(root, allow_not_found=True))):
        raise FileExistsError(f"{out} is in use: archives are written to a folder of their own")
    payload, page_id = F.coalesce("html", F.lit("")), F.col("page_id").cast("long")
    place = F.coalesce(page_id, F.lit(NULL_ID)).alias("place")
    keyed = staged(pages.select(place, page_id.alias("page_id"), F.octet_length(payload).cast("long").alias("n"), F.sha1(payload.cast("binary")).alias("digest")), "digests")
    same = keyed.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    pairs = keyed.select("place", "page_id", "digest").distinct().withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALT)))
    salted = same.select("digest", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    repeats = pairs.join(salted, ["digest", "salt"])
    nothing = F.lit(None).cast("string")
    rows = pages.select(place, page_id.alias("page_id"), "url", "html", F.lit(1).alias("kind"), nothing.alias("digest"), F.lit(None).cast("long").alias("last"))
    rows = rows.union(repeats.select("place", "page_id", nothing.alias("url"), nothing.alias("html"), F.lit(0).alias("kind"), "digest", "last"))
    dealt, shards = with_shard(rows, keyed, shard_bytes, F.coalesce("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    dealt = dealt.drop("place").repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    manifest = staged(dealt.mapInArrow(writer(out, roll_bytes), MANIFEST), "manifest")
    committed = staged(map_slices(manifest, mover(out), MANIFEST), "committed")
    committed.write.parquet(f"{out}/_manifest")
    if target.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        target.delete_dir(f"{root}/_temporary")
    return committed


class Roll:
    """The file being written: a temporary name of this attempt until it is full."""

    def __init__(self, out: str, shard: int, seq: int, attempt: str):
        self.fs, root = fs.FileSystem.from_uri(out)
        self.shard, self.seq, self.name = shard, seq, f"pages-{shard:05d}-{seq:05d}.warc.gz"
        self.temporary = f"{root}/_temporary/{self.name}.{attempt}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.stream, self.records, self.bytes, self.hash = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.add(member("warcinfo", [("WARC-Record-ID", record_id(self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: clipflow\r\nformat: WARC File Format 1.1\r\n"), 0)

    def add(self, data: bytes, records: int = 1) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.records += records
        self.bytes += len(data)

    def closed(self) -> pa.RecordBatch:
        self.stream.close()
        row = {"shard": self.shard, "seq": self.seq, "temporary": self.temporary, "name": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()}
        return pa.RecordBatch.from_arrays([pa.array([row[k]], pa.int32() if k in ("shard", "seq") else pa.int64() if k in ("records", "bytes") else pa.string()) for k in row], names=list(row))


def writer(out: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roll, page, last, answered = uuid.uuid4().hex, None, None, {}, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if roll and (row["shard"] != roll.shard or roll.bytes >= roll_bytes):
                        yield roll.closed()
                        roll = Roll(out, row["shard"], roll.seq + 1 if row["shard"] == roll.shard else 0, attempt)
                    elif not roll:
                        roll = Roll(out, row["shard"], 0, attempt)
                    if page != (row["shard"], row["page_id"]):
                        page, last, answered = (row["shard"], row["page_id"]), {}, set()
                    if row["kind"] == 0:
                        last[row["digest"]] = row["last"]
                        continue
                    payload = (row["html"] or "").encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    revisit = digest in last and (last[digest] != row["page_id"] or digest in answered)
                    answered.add(digest)
                    roll.add(page_record(row["page_id"], row["url"], payload, last.get(digest), revisit))
        if roll:
            yield roll.closed()

    return run


def mover(out: str):
    """Rename temporary files; a repeated attempt finds them renamed already."""

    def step(batch):
        target, root = fs.FileSystem.from_uri(out)
        for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
            if target.get_file_info(temporary).type == fs.FileType.File:
                target.move(temporary, f"{root}/{name}")
            elif target.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                raise FileNotFoundError(f"neither {temporary} nor {name} is there")
        return {n: batch.column(n) for n in batch.schema.names}

    return step


def members(data) -> Iterator[bytes]:
    """The gzip members of ``data``, unpacked one at a time."""
    view, at, piece = memoryview(data), 0, 1 << 15
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            part = view[at : at + piece]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(out)


def parsed(record: bytes) -> dict | None:
    """A page's record; None for other types. A response's size and digest are made from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    number = lambda k: int(headers[k]) if k in headers else None
    row = {"page_id": number("X-Page-ID"), "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "url": headers.get("WARC-Target-URI")}
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        return row | {"payload": None, "payload_bytes": number("X-Payload-Length"), "payload_digest": digest}
    payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]
    if base32_sha1(payload) != digest:
        raise ValueError(f"page {row['page_id']}: the payload does not have its digest")
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def read_archives(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """Every page record of the archives that the manifest in ``out`` names; without ``payload`` only what describes it."""
    names = [n for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload") if payload or n != "payload"]
    schema = RECORDS if payload else RECORDS.rsplit(", ", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        target, root = fs.FileSystem.from_uri(out)

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for file in batch.to_pylist():
                with target.open_input_stream(f"{root}/{file['name']}", compression=None) as stream:
                    content = stream.read()
                if len(content) != file["bytes"] or hashlib.sha256(content).hexdigest() != file["sha256"]:
                    raise ValueError(f"{file['name']} is not the file of the manifest")
                rows = []
                for record in members(content):
                    if row := parsed(record):
                        rows.append(row)
                    if len(rows) >= 256:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    files = manifest.count()
    return manifest.select("name", "bytes", "sha256").repartition(max(1, min(files, MOST)), "name").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), out)
    return read_archives(spark, out, payload=False).drop("url")
