"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An Arrow batch on its way to Python: texts may be long, and the tasks of an executor share its memory.
BATCH_ROWS, BATCH_BYTES = 500, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a new one under the local temp folder only where none is set (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/waymark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing before it.

    few: rows are few beside what they come from, and are rebalanced into few files.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df = df.hint("rebalance") if few else df
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Within it, plans send Python no more than BATCH_ROWS rows or BATCH_BYTES bytes at once."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about size bytes of a text or binary column: small ones are joined, large ones cut, a row is never cut."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = int(np.searchsorted(upto, done + size - n, side="right"))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                n += int(upto[to - 1]) - done
                at, done = to, int(upto[to - 1])
            if at < batch.num_rows or n >= size:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_slice(hex_digest: Column, slices: int) -> Column:
    """0 .. slices - 1 from a hexadecimal digest, in the digest's own order."""
    return F.floor(F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(2**32)).cast("int")


def ranked(df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], out: str) -> DataFrame:
    """Adds out, the 0-based place of a row among the rows of its keys (which hold no null); slice_of must not fall as order rises.

    A key may hold any share of the rows: rows are numbered within (keys, slice), and a slice starts at the
    sum of the counts of those before it, so that no task sees more than a slice of a key.
    """
    by = [*keys, "_slice"]
    df = df.withColumn("_slice", slice_of)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return numbered.join(starts, by).withColumn(out, F.col("_start") + F.col("_in")).drop("_slice", "_in", "_start")


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row, in the order of all columns, of those with equal keys (nulls are equal); rows are compared before they are shuffled, so that a key may hold any share of them."""
    return df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("_row")).select("_row.*")
