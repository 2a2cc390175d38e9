"""Arrays of rounded numbers keep the sign of zero, as the SQL does."""

import os
import tempfile

import duckdb
import pytest

from clipflow.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["joint_subset", "norm_points", "pack_slots", "pad_batch"])
def test_negative_zeros(spark, name):
    sf = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, [(-1) ** (i + j) * 10.0 ** -(j % 9 + 1) for j in range(64)], i % 2) for i in range(12)] + [(12, [-0.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{sf}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings.parquet')}/*.parquet'")
    got = sorted(repr([list(v) if isinstance(v, (list, tuple)) else v for v in r]) for r in QUERIES[name](spark, sf).collect())
    assert got == sorted(repr(list(r)) for r in con.execute(ORACLES[name]).fetchall())
    assert "-0.0," in " ".join(got)
