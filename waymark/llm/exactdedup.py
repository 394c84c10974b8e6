"""Exact dedup by content sort.

Rows are range-partitioned by their normalised bytes, each partition is sorted externally, so that equal texts stand next to each other, and the
window compares neighbours in full and keeps the smallest identifier. Only DataFrame functions run.

Spark samples the splitters and sends them to the driver, so they are short: the first PREFIX characters, then a hash (texts with the same beginning may
be many), then the salt.

Hot texts: a text with over 1/4096 of all rows is split over salts before the sort (at most 4096 texts can be so
frequent, which bounds the broadcast list of their digests), by the rows' places in their files, so that rows of one identifier are split too; the survivors of each salt are sorted once more.

Defined results: null text counts as empty, and all empty texts are one group; a text of white space alone is one
space, which isn't the empty text. Identifiers are compared as they are; of rows with the smallest identifier twice,
every one of them carries it as keep_id, and `kept` is true for all of those. A null identifier sorts first, as in
Spark's ascending order. Only the identifier and the text are read, so
other columns of the input can't clash with the result's. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import one_of_each, shuffle_width, stash

HOT_SHARE, PREFIX = 4096, 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("row"))

    total = docs.count()
    hot = (
        rows.groupBy(F.xxhash64("norm").alias("hot_h"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & (F.col("n") * HOT_SHARE > total))
        .select("hot_h", F.ceil(F.col("n") * HOT_SHARE / max(total, 1)).alias("salts"))
    )  # at most HOT_SHARE rows
    salted = rows.join(F.broadcast(hot), F.xxhash64("norm") == F.col("hot_h"), "left").select(
        "doc_id", "norm", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(0)).alias("salt"), F.col("salts").isNotNull().alias("hot")
    )

    salted = salted.withColumns({"prefix": F.substring("norm", 1, PREFIX), "tail": F.xxhash64("norm")})
    alike = Window.partitionBy("prefix", "tail", "salt", "norm").orderBy("doc_id")
    whole = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = (
        salted.repartitionByRange(shuffle_width(spark), "prefix", "tail", "salt")
        .withColumn("near_id", F.first("doc_id").over(alike))
        .withColumn("place", F.row_number().over(alike))
        .withColumn("near_n", F.count(F.lit(1)).over(whole))
        .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "near_id", "near_n", "hot", F.when(F.col("hot") & (F.col("place") == 1), F.col("norm")).alias("hot_norm"))
    )
    sorted_rows = stash(sorted_rows, "sorted")

    again = Window.partitionBy("hot_norm").orderBy("near_id")
    merged = (
        sorted_rows.where(F.col("hot_norm").isNotNull())
        .repartitionByRange(shuffle_width(spark), "hot_norm")
        .withColumn("keep", F.first("near_id").over(again))
        .withColumn("n", F.sum("near_n").over(again.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(again))
        .where("place = 1")
        .select(F.col("text_sha256").alias("hot_sha"), "keep", "n")
    )  # a row for each hot text
    found = sorted_rows.join(F.broadcast(merged), F.col("hot") & (F.col("text_sha256") == F.col("hot_sha")), "left")
    keep = F.when(F.col("hot_sha").isNotNull(), F.col("keep")).otherwise(F.col("near_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", "near_n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the smallest identifier.

    Rows are told apart by identifier and text, so that an identifier which stands for several texts loses only those that others
    have. Rows that repeat both are one document: the first of them in the order of all columns stays.
    """
    marks = exact_duplicates(docs, id_col, text_col).where("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marks = stash(marks.agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("NOT _kept OR _n > 1"), "marks")
    rows = docs.withColumn("_text_sha256", F.sha2(normalised(F.col(text_col)), 256))
    same = rows[id_col].eqNullSafe(F.col("_id")) & (F.col("_text_sha256") == F.col("_sha"))
    single = rows.join(marks, same, "left_anti")
    repeated = marks.where("_kept")
    if not repeated.isEmpty():
        single = single.unionByName(one_of_each(rows.join(repeated, same, "left_semi"), [id_col, "_text_sha256"]))
    return single.select(*docs.columns)
