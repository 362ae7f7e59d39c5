"""Shared helpers: tables, scratch tables in the shared folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Byte bound of the text handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests, one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: its lineage ends there.

    A lost executor costs a re-read of the table, not the work behind it. The
    folder belongs to the job; whoever names it removes it with the job.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(
    df: DataFrame, schema: str, columns: Callable[[pa.RecordBatch], list]
) -> DataFrame:
    """Apply ``columns(batch)`` to runs of rows of about CHUNK_BYTES; it returns a list or Arrow
    array for each column of ``schema``, of any one length."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = columns(part)
                yield record_batch(values, arrow)

    return importable(df).mapInArrow(run, schema)


def importable(df: DataFrame) -> DataFrame:
    """``df``; Python workers beside the driver will find this package where the driver does.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return df


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T.DataType.fromDDL(schema))


def record_batch(values: list, arrow: pa.Schema) -> pa.RecordBatch:
    """A batch of one list or Arrow array for each column."""
    arrays = [
        v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type)
        for v, f in zip(values, arrow)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def slices(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
