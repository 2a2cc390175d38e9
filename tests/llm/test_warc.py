"""The archives' folder, manifest and shards."""

import pytest
from pyspark.sql import functions as F

from clipflow.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_a_used_folder_is_refused(spark, tmp_path):
    out = f"file://{tmp_path}/a"
    warc.write(pages_of(spark, [(i, "http://a.org/", f"page {i}") for i in range(180)]), out)
    with pytest.raises(FileExistsError):
        warc.write(pages_of(spark, [(i, "http://a.org/", f"other {i}") for i in range(5)]), out)
    (tmp_path / "a" / "pages-99999-00000.warc.gz").write_bytes(b"stray")
    assert warc.read_archives(spark, out).count() == 180


def test_missing_and_changed_files_fail(spark, tmp_path):
    out = f"file://{tmp_path}/b"
    m = warc.write(pages_of(spark, [(i, "http://a.org/", f"page {i} " * 200) for i in range(50)]), out, shard_bytes=20_000, roll_bytes=2_000).collect()
    assert len(m) > 3
    file = tmp_path / "b" / m[1].name
    content = file.read_bytes()
    file.write_bytes(content[:-1] + b"x")
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_archives(spark, out).collect()
    file.unlink()
    with pytest.raises(Exception, match="(?i)no such file|not found"):
        warc.read_archives(spark, out).collect()


def test_a_lost_file_stops_the_second_job(tmp_path):
    import pyarrow as pa

    batch = pa.record_batch({"temporary": [f"{tmp_path}/gone"], "name": ["never.warc.gz"]})
    with pytest.raises(FileNotFoundError):
        warc.mover(f"file://{tmp_path}")(batch)


def test_outlying_ids_have_even_shards(spark, tmp_path):
    rows = [(i, "http://a.org/", f"{i} " * 1500) for i in range(200)] + [(1 << 60, "http://a.org/", "far " * 1500), (-(1 << 61), None, "low " * 1500)]
    out = f"file://{tmp_path}/c"
    held = warc.write(pages_of(spark, rows), out, shard_bytes=100_000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert len(held) == -(-sum(len(r[2]) + 1 for r in rows) // 100_000) and max(r.n for r in held) < 2.2 * min(r.n for r in held)
    assert warc.read_archives(spark, out).count() == 202


def test_an_id_with_many_pages_is_split(spark, tmp_path):
    rows = [(7, "http://a.org/", f"{i} " * 1500) for i in range(100)] + [(i, "http://a.org/", f"x{i} " * 1500) for i in range(50)]
    out = f"file://{tmp_path}/d"
    held = warc.write(pages_of(spark, rows), out, shard_bytes=100_000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert max(r.n for r in held) < 40 and len(held) > 5
    assert sorted(r.page_id for r in warc.read_archives(spark, out).collect()) == sorted(r[0] for r in rows)


def test_edges_find_their_place(spark):
    keyed = spark.range(1000).select((F.col("id") * 17 - 4000).alias("place"), F.lit(99).cast("long").alias("n"))
    found, shards = warc.edges(keyed, 1000)
    assert shards == 100 == len(found) and found == sorted(found)
    got, n = warc.with_shard(keyed, keyed, 1000, F.lit("00000000"))
    firsts = [p for p, _, _ in found]
    assert n == 100 and all(r.shard == sum(f <= r.place for f in firsts) - 1 for r in got.collect())
