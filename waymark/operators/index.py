"""A stored inverted index: for every term, sorted arrays of identifiers by range, in a table bucketed by term, with the terms' counts beside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE, BUCKETS = 65_536, 16
#: Queries in a slice, queries that are answered together, and numbers that a task holds before it gives them out.
AT_ONCE, QUERIES, HELD = 50_000, 1000, 500_000
#: Pairs that a row with arrays of queries and identifiers stands for, and queries in it: Spark holds all pairs of such a row at once where they are written.
PAIRS, TOGETHER = 16_384, 128


def build(postings: DataFrame, name: str, path: str, span: int = RANGE, buckets: int = BUCKETS) -> None:
    """Writes postings (term, id) as the tables `name` (term, span, ids) and `name`_counts (term, n), under path.

    A row holds a term's identifiers within a range of `span` numbers, so that it has a bound whatever the term; a posting that repeats is one.
    """
    rows = postings.where("term IS NOT NULL AND id IS NOT NULL").select("term", F.col("id").cast("long").alias("id"))
    lists = rows.groupBy("term", F.floor(F.col("id") / span).alias("span")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    lists.repartition(buckets, "term").write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "span").option("path", f"{path}/lists").saveAsTable(name)
    stored = postings.sparkSession.table(name)
    counts = stored.groupBy("term").agg(F.sum(F.size("ids")).alias("n"))
    counts.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").option("path", f"{path}/counts").saveAsTable(f"{name}_counts")


def ordered_terms(asked: DataFrame, name: str) -> DataFrame:
    """query_id, first (the query's rarest term) and others; queries with a term that nothing has are left out."""
    counts = asked.sparkSession.table(f"{name}_counts")
    wanted = asked.where("term IS NOT NULL").select("query_id", "term").distinct().join(counts, "term", "left")
    terms = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("terms"))
    return terms.where(F.col("terms")[0]["n"] > 0).select("query_id", F.col("terms")[0]["term"].alias("first"), F.transform(F.slice("terms", F.lit(2), F.size("terms")), lambda t: t["term"]).alias("others"))


def find_all(asked: DataFrame, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """query_id, id: what has all terms of a query (query_id, term).

    Every range of the index is intersected on its own, by tasks that read its lists once, and then the queries whose rarest term it has, in slices of about at_once; a list is never
    sent along with a query, and equal queries of a slice are answered once. Pairs are made at the very end, from arrays, PAIRS at most from a row.
    """
    lists = asked.sparkSession.table(name)
    terms = ordered_terms(asked, name)
    n = terms.count()
    slices = max(8, n // at_once + 1) if n > 64 else 1
    there = terms.join(lists.select("term", "span"), F.col("first") == F.col("term"))
    queries = there.select("span", F.pmod(F.xxhash64("query_id"), F.lit(slices).cast("long")).alias("slice"), F.concat(F.array("first"), "others").alias("terms"), "query_id")
    needed = lists.join(asked.select("term").distinct(), "term", "left_semi")
    needed = needed.select("span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.array("term").alias("terms"), "ids")
    both = needed.unionByName(queries, allowMissingColumns=True).withColumn("asks", F.col("ids").isNull())
    width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = both.repartition(width, "span", "slice").sortWithinPartitions("span", "slice", "asks", "terms")
    kind = asked.schema["query_id"].dataType.simpleString()
    found = order.select("span", "slice", "asks", "terms", "ids", "query_id").mapInArrow(_intersected, f"queries array<{kind}>, ids array<bigint>")
    return found.select(F.explode("queries").alias("query_id"), "ids").select("query_id", F.explode("ids").alias("id"))


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (span, slice), lists before queries and those by their terms: queries with the same terms, and some of what all of these have."""
    here, lists, last, ids, own = None, {}, None, None, []
    kind, out, held = None, [], 0

    def hold() -> int:
        size = PAIRS // min(len(own), TOGETHER)
        new = [(own[q : q + TOGETHER], ids[i : i + size]) for i in range(0, len(ids), size) for q in range(0, len(own), TOGETHER)]
        out.extend(new)
        return sum(len(q) + len(i) for q, i in new)

    def made() -> pa.RecordBatch:
        queries, found = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(queries, pa.list_(kind)), _nested(found)], names=["queries", "ids"])

    for batch in batches:
        kind = batch.column("query_id").type
        column = batch.column("ids")
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        for i, (span, part, asks, terms, query) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("span", "slice", "asks", "terms", "query_id")), strict=True)):
            if own and ((span, part) != here or not asks or terms != last or len(own) >= QUERIES):
                held += hold()
                own = []
            if (span, part) != here:
                here, lists, last = (span, part), {}, None
            if not asks:
                lists[terms[0]] = values[ends[i] : ends[i + 1]].copy()
                continue
            if terms != last:
                last, ids = terms, _common([lists.get(t) for t in terms])
            if len(ids):
                own.append(query)
            if held > HELD:
                yield made()
                out, held = [], 0
    if own:
        hold()
    if out:
        yield made()


def _common(lists: list[np.ndarray | None]) -> np.ndarray:
    """What ascending lists have in common, none where one is missing."""
    if any(x is None for x in lists):
        return np.zeros(0, "i8")
    common, *more = sorted(lists, key=len)
    for x in more:
        if len(common):
            common = common[x[np.minimum(np.searchsorted(x, common), len(x) - 1)] == common]
    return common


def _nested(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def drop(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_counts"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def grams(text: Column, most: int = 3) -> Column:
    """All distinct substrings of 1 to `most` letters."""

    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)]))


def own_grams(part: Column, most: int = 3) -> Column:
    """The grams that a text must have to contain part: all of `most` letters, or part itself where it is shorter."""
    last = F.length(part) - most + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(part, i, F.lit(most))))).otherwise(F.array(part))
