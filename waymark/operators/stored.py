"""Stored tables as Parquet files by partition, of which only what changes is written again."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.tables import write_partitions

#: What Spark names the folder of a null.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def _at(spark: SparkSession, path: str):
    """The path's file system, through which all folders are reached, and its path there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _at(spark, path)
    return files.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    files, there = _at(spark, path)
    files.delete(there, True)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written as Parquet where executors and driver both write (under the checkpoint folder, else the warehouse) and read again, so that they are worked out once."""
    spark = rows.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def partitions(spark: SparkSession, path: str, by: str) -> dict[str | None, str]:
    """The values of a partition column, as texts, with their folders."""
    files, there = _at(spark, path)
    found = {}
    for status in files.listStatus(there) if files.exists(there) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{by}="):
            value = unquote(name.removeprefix(f"{by}="))
            found[None if value == NULL_NAME else value] = status.getPath().toString()
    return found


def of_partitions(rows: DataFrame, by: str, values: list) -> DataFrame:
    """The rows of some partitions; the others' files aren't read."""
    known = [v for v in values if v is not None]
    rule = F.col(by).isin(known) if known else F.lit(False)
    return rows.where(rule | F.col(by).isNull() if None in values else rule)


def rewrite(rows: DataFrame, path: str, by: str, values: list) -> None:
    """Puts rows in the place of the given partitions (texts, or null); one that rows lacks is dropped, and no other file is touched.

    Rows may come from the table itself: they are written beside it first, and from there into it, so that nothing is lost if either step is broken off and repeated.
    """
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    new = spark.read.schema(rows.schema).parquet(beside)
    has = {None if r[0] is None else str(r[0]) for r in new.select(by).distinct().collect()}  # of the given partitions
    if has:
        write_partitions(new, path, by)
    there = partitions(spark, path, by)
    for value in values:
        if value not in has and value in there:
            remove(spark, there[value])
    remove(spark, beside)


def retain_days(spark: SparkSession, path: str, before: Column, ts: str = "criado_em", by: str = "dia") -> DataFrame:
    """Takes rows older than `before` out of a log that is stored by day; one row: removed (rows), dropped and rewritten (days).

    Whole days that are over go with their files, whose rows are counted by what the files say of themselves; of the day that `before` is in, the later rows are written
    again; nothing else is read or written. Rows without a time stay. Repeating it removes nothing.
    """
    day, = spark.range(1).select(F.date_format(before, "yyyy-MM-dd")).first()
    log = spark.read.parquet(path)
    there = partitions(spark, path, by)
    over = sorted(v for v in there if v is not None and v < day)
    removed = 0
    for value in over:  # a day each
        removed += spark.read.parquet(there[value]).count()
        remove(spark, there[value])
    rewritten = 0
    if day in there:
        own = of_partitions(log, by, [day])
        old = own.where(F.col(ts) < before).count()
        if old:
            rewrite(own.where(~(F.col(ts) < before) | F.col(ts).isNull()), path, by, [day])
            removed, rewritten = removed + old, 1
    return spark.createDataFrame([(removed, len(over), rewritten)], "removed long, dropped long, rewritten long")
