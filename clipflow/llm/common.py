"""What the corpus operators share: table access, staged tables and the Arrow row helper."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that one Python step handles at a time; bounds the memory of a task whatever the Arrow batch holds.
SLICE_ROWS = 256
#: Bytes of such a step: a slice that is larger is halved, down to single rows.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    Only where that setting is absent, as in local tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_clipflow_local_dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(root)
            spark._clipflow_local_dir = root  # type: ignore[attr-defined]
    return f"{root.rstrip('/')}/clipflow-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_slices(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: T.StructType | str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` in slices of ``rows``; ``step`` gets a slice and returns the columns of its output (None: no rows)."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                if (out := step(part)) is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        waiting = [batch.slice(at, rows)]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
