"""Views on a request log. `now` is always given, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import SERVICES


def since(log: DataFrame, now: Column, hours: int) -> DataFrame:
    return log.where(F.col("criado_em") > now - F.expr(f"INTERVAL {hours} HOURS"))


def rounded(value: Column, places: int) -> Column:
    """As SQL rounds numerics: halves away from zero, on a decimal."""
    return F.round(value.cast("decimal(20,6)"), places).cast("double")


def overview(log: DataFrame, now: Column, accuracy: int | None = None) -> DataFrame:
    """One row on the last 24 hours. The percentile is exact, from counts of distinct durations; with accuracy it is approximate, from a sketch of that size."""
    s = F.col("status")
    p95 = F.percentile("duracao_ms", 0.95) if accuracy is None else F.percentile_approx("duracao_ms", 0.95, accuracy)
    return since(log, now, 24).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s < 400).alias("ok"),
        F.count_if((s >= 400) & (s < 500)).alias("client_errors"),
        F.count_if(s >= 500).alias("server_errors"),
        F.count_if("rate_limited").alias("rate_limited"),
        F.count_distinct("ip").alias("ips"),
        rounded(F.avg("duracao_ms"), 1).alias("mean_ms"),
        rounded(p95, 1).alias("p95_ms"),
    )


def by_route(log: DataFrame, now: Column) -> DataFrame:
    errors = F.count_if(F.col("status") >= 400)
    out = since(log, now, 24).groupBy("rota").agg(
        F.count(F.lit(1)).alias("total"), errors.alias("errors"), rounded(100.0 * errors / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("error_pct"), rounded(F.avg("duracao_ms"), 1).alias("mean_ms")
    )
    return out.orderBy(F.desc("total"), "rota")


def cache_rate(log: DataFrame, now: Column) -> DataFrame:
    hits, known = F.count_if("cache_hit"), F.count("cache_hit")
    out = since(log, now, 24).where(F.col("cache_hit").isNotNull()).groupBy("rota").agg(
        F.count(F.lit(1)).alias("total"), hits.alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"), rounded(100.0 * hits / F.nullif(known, F.lit(0)), 2).alias("hit_pct")
    )
    return out.orderBy(F.desc("total"), "rota")


def recent_errors(log: DataFrame, most: int = 100) -> DataFrame:
    return log.where(F.col("status") >= 400).orderBy(F.desc("criado_em"), F.desc("id")).limit(most)


def hourly(log: DataFrame, now: Column | None = None, hours: int = 48) -> DataFrame:
    rows = log if now is None else since(log, now, hours)
    out = rows.groupBy(F.date_trunc("hour", "criado_em").alias("hour")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("errors"), F.count_distinct("ip").alias("ips"))
    return out.orderBy(F.desc("hour"))


def sketch_names(columns: list[str]) -> list[str]:
    return ["ips"] + ["durations"] * ("duracao_ms" in columns)


def sketches(columns: list[str]) -> list[Column]:
    """Aggregates that can be merged: of addresses (for distinct counts), and of durations (for quantiles) where the log has them."""
    return [F.hll_sketch_agg("ip", 14).alias("ips"), *[F.kll_sketch_agg_bigint(F.col("duracao_ms").cast("long"), 400).alias("durations")] * ("duracao_ms" in columns)]


def hour_sketches(log: DataFrame) -> DataFrame:
    """hour, total, errors, and sketches as binary: what is needed of a log for any span of whole hours."""
    return log.groupBy(F.date_trunc("hour", "criado_em").alias("hour")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("errors"), *sketches(log.columns))


def merged(hours: DataFrame, *by: Column) -> DataFrame:
    """by, total, errors (exact), ips (approximate) and p95_ms (approximate, where durations were kept) of hours together; without by, one row."""
    out = hours.groupBy(*by).agg(
        F.sum("total").alias("total"),
        F.sum("errors").alias("errors"),
        F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("ips"),
        *[F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("durations"), F.lit(0.95)).alias("p95_ms")] * ("durations" in hours.columns),
    )
    return out


def retain(log: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row with the number of those removed."""
    old = F.col("criado_em") < now - F.expr(f"INTERVAL {days} DAYS")
    return log.where(~old | F.col("criado_em").isNull()), log.agg(F.count_if(old).alias("removed"))


def allowed(log: DataFrame, limit: int = 15, seconds: int = 60, by: str = "ip") -> DataFrame:
    """log with n (a request's place in its client's fixed window), allowed and remaining; rows without a client are always allowed.

    A client's window holds the requests of one minute, so its rows fit a task; clients with very many requests have many windows.
    """
    bucket = F.floor(F.unix_millis("criado_em") / (seconds * 1000))
    known = F.col(by).isNotNull()
    n = F.row_number().over(Window.partitionBy(by, "bucket", F.when(~known, F.col("id"))).orderBy("criado_em", "id"))  # those without a client aren't ranked together
    out = log.withColumn("bucket", bucket).withColumn("n", F.when(known, n))
    return out.withColumns({"allowed": ~known | (F.col("n") <= limit), "remaining": F.when(known, F.greatest(F.lit(0), F.lit(limit) - F.col("n"))).otherwise(F.lit(limit))})


def cities_with_several(facilities: DataFrame) -> DataFrame:
    return facilities.groupBy("uf", "municipio").agg(F.count(F.lit(1)).alias("units")).where("units > 1")


def service_set(facilities: DataFrame, services: Column) -> DataFrame:
    return facilities.select(F.explode(services).alias("service")).distinct()


def service_grid(facilities: DataFrame, services: Column) -> DataFrame:
    """id and a boolean column for each service."""
    return facilities.withColumn("_s", services).select("id", *[F.array_contains("_s", s).alias(f"s{i}") for i, s in enumerate(SERVICES)])


def extent(facilities: DataFrame) -> DataFrame:
    return facilities.agg(
        F.bool_or(F.col("fonte_extracao") == "pdf_ocr").alias("any_review"),
        F.bool_or(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("any_coords"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"),
    )
