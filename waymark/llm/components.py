"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join back to the links, both on small rows; minima are written before they are joined, so that
adaptive execution can split the links of a node that has very many.

Defined results: links may repeat, go either way or from a node to itself; a node whose links all are to itself counts as having none. A link with a null end is none.
Without links the result is empty. Only the two columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stash


def _canonical(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.hash("v", F.lit("v"), "u").cast("long")).alias("g")).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (the smallest identifier it reaches) for every identifier that has a link to another."""
    links = stash(_canonical(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    mark = _mark(links)
    while mark[0]:  # a number of steps that grows with the logarithm of the longest chain
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        links = stash(_canonical(large), "links")

        least = stash(links.groupBy("u").agg(F.min("v").alias("w")), "least")
        moved = links.join(least, "u")
        small = moved.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(least.select("u", F.col("w").alias("v")))
        links = stash(_canonical(small), "links")
        if (now := _mark(links)) == mark:
            break
        mark = now
    low = links.select(F.col("v").alias("id")).distinct()
    return stash(links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(low.select("id", F.col("id").alias("component"))), "components")
