"""What the operators of this subpackage share: scratch tables and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustloom.session import on_workers, shared_dir

__all__ = ["WORD", "chunks", "on_workers", "removed_after", "row_struct", "scratch", "shared_dir", "table"]

#: The white space of the contracts, as a Java pattern for words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the scratch tables written in each open removed_after().
_OPEN: list[list[str]] = []


@contextmanager
def removed_after(spark: SparkSession):
    """Removes the scratch tables that are written within; what is made from them must have been written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dustloom-{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Arrow batches gathered to tables of about most_bytes; a batch above that is cut into slices of rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // most_bytes)))
        step = -(-batch.num_rows // parts)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if held and size + batch.nbytes // parts > most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += batch.nbytes // parts
    if held:
        yield pa.Table.from_batches(held)


def row_struct(df: DataFrame, name: str):
    """All columns of df as one struct column, so that names of the user's columns can't clash with ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)
