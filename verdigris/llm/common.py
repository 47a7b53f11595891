"""Helpers that the operators share: scratch folders, Arrow batch sizes, text arrays, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.graphs import workspace as scratch
from verdigris.operators.joins import common_values, spread_join  # noqa: F401

#: Bytes of one Arrow batch handed to Python; bounds what a worker holds, whatever the rows' lengths.
BATCH_BYTES = 2 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: a worker never holds more than a few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


#: Rows that a file of a staged table holds about.
FILE_ROWS = 1 << 16


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to a scratch folder and read again: lineage is cut, a lost executor costs nothing.

    With rows, about how many the table or what it comes from has, small partitions are put together: a file for
    FILE_ROWS rows, but enough tasks to keep all cores busy. Else a small table would be as many files as there are
    partitions.
    """
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    # the usual codec keeps direct buffers for each column of each file until the heap is collected
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*dfs: DataFrame) -> None:
    """Delete the folders of staged tables that nothing will read any more."""
    for df in dfs:
        delete(df.sparkSession, df.staged_at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remainder(col: str, mod: int) -> Column:
    """crc32 of a column's text form, modulo mod; null counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(each, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The column's values one at a time, null as the empty text; never all at once as Python objects."""
    for x in batch.column(column):
        yield x.as_py() or ""


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """uint64 hashes as doubles in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * (2.0**-53)
