"""URL filter: rules on hosts and paths, and logistic regression on hashed character n-grams for the rest.

The regression is fitted by gradient descent, each weight at a pace of its own (its slopes so far), on a small labelled table; each step is one aggregation of a DataFrame, and its weights (BUCKETS
numbers) come back to the driver. Scoring sums an array's entries per n-gram: those of the host and those of the path are scaled by their own numbers, so that
a long path doesn't outweigh the host. Only DataFrame functions run.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the intercept alone.
Labelled rows with a null url or label are left out; without any labelled row everything is allowed. At a probability of exactly one half
the verdict is allow. Repeated rows are judged alike. Very long urls are read whole. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stash

BUCKETS, SIZES, ROUNDS, RATE, DECAY, MOST_LABELLED = 4096, (3, 4, 5), 12, 0.5, 1e-2, 20_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), CAPITALS, CAPITALS.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _bucket_at(text: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n)), F.lit(n)), F.lit(BUCKETS)).cast("int")


def ngrams(host: Column, path: Column) -> Column:
    """Structs (b, s): the distinct buckets of the character n-grams of ^host/ and of path$, each with one over the square root of their number."""
    both = []
    for text in (F.concat(F.lit("^"), host, F.lit("/")), F.when(F.length(path) > 1, F.concat(path, F.lit("$"))).otherwise(F.lit(""))):
        parts = []
        for n in SIZES:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _bucket_at(text, n)))
        both.append(F.array_distinct(F.concat(*parts)))
    return F.concat(*[F.get(F.transform(F.array(grams), _scaled), F.lit(0)) for grams in both])


def _scaled(grams: Column) -> Column:
    """Of a lambda's variable, so that the n-grams are made once and not for each of them."""
    return F.transform(grams, lambda b: F.struct(b.alias("b"), (1 / F.sqrt(F.size(grams).cast("double"))).alias("s")))


def fit(labelled: DataFrame, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """BUCKETS weights and the intercept, for labelled (url, blocked boolean); at most MOST_LABELLED rows, chosen by hash."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).orderBy(F.xxhash64("url"), "url", "blocked").limit(MOST_LABELLED)
    rows = rows.select(ngrams(host(F.col("url")), path(F.col("url"))).alias("g"), F.col("blocked").cast("double").alias("y"))
    rows = stash(rows.where(F.size("g") > 0).coalesce(1), "labelled")
    n = rows.count()
    weights, moved = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    intercept = F.array(F.struct(F.lit(BUCKETS).alias("b"), F.lit(1.0).alias("s")))
    for _ in range(rounds if n else 0):
        missed = rows.select("g", (F.col("y") - probability(F.col("g"), weights)).alias("e"))  # before the explode, once a row
        by_bucket = missed.select("e", F.explode(F.concat("g", intercept)).alias("x")).groupBy("x.b").agg(F.sum(F.col("e") * F.col("x.s")).alias("s"))
        steps = {r["b"]: r["s"] for r in by_bucket.collect()}  # BUCKETS + 1 rows at most
        moved = [moved[i] + (steps.get(i, 0.0) / n) ** 2 for i in range(BUCKETS + 1)]
        weights = [w * (1 - decay) + rate * steps.get(i, 0.0) / n / (moved[i] + 1e-12) ** 0.5 for i, w in enumerate(weights)]
    return weights


def probability(grams: Column, weights: list[float]) -> Column:
    """Of a url being one to block."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")  # one literal, folded once
    total = F.aggregate(grams, F.lit(0.0), lambda acc, x: acc + F.get(table, x["b"]) * x["s"])
    return 1 / (1 + F.exp(-(F.lit(float(weights[BUCKETS])) + total)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as a struct (n, rule, verdict): its host or a subdomain of it, and a path that starts with the rule's."""
    fits = [
        F.when(
            ((host == F.lit(h)) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the method's probability of `block`."""
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_fit", rule_for(F.col("host"), F.col("path"), rules)) if rules else rows.withColumn("_fit", F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    rows = rows.withColumn("block_probability", probability(ngrams(F.col("host"), F.col("path")), weights))
    method = F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", method).alias("verdict"), "block_probability")
