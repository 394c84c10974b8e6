"""Geocoding and postal codes as joins with lookup tables that also know their misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import clean_address, street
from waymark.operators.tables import insert_missing, upsert


def three_state(keys: DataFrame, cache: DataFrame, key: str = "query_key") -> DataFrame:
    """keys with state (absent, miss or hit), lat, lng and fonte (`cache` for hits)."""
    known = cache.select(key, "lat", "lng", F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "absent").when(F.col("lat").isNull() | F.col("lng").isNull(), "miss").otherwise("hit")
    return keys.join(known, key, "left").withColumn("state", state).withColumn("fonte", F.when(F.col("state") == "hit", "cache")).drop("_known")


def candidates(facilities: DataFrame, country: str = "Brasil") -> DataFrame:
    """id, pos, query_key: the address cleaned, the street alone, the city; only the city where there is no address."""
    tail = F.concat(F.lit(", "), F.col("municipio"), F.lit(", "), F.col("uf"), F.lit(f", {country}"))
    clean = clean_address(F.col("endereco"))
    city = F.concat(F.col("municipio"), F.lit(", "), F.col("uf"), F.lit(f", {country}"))
    has = F.coalesce(F.col("endereco"), F.lit("")) != ""
    keys = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(i).alias("pos"), key.alias("query_key"))) for i, (rule, key) in enumerate(((has, F.concat(clean, tail)), (has, F.concat(street(clean), tail)), (F.lit(True), city)))]))
    return facilities.select("id", F.explode(keys).alias("c")).select("id", "c.*")


def resolve(facilities: DataFrame, resolver: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, lat, lng, pos, query_key of the first candidate that resolves; ids without one are kept with nulls.

    resolver is any table (query_key, lat, lng): each distinct key is looked up once, however many facilities ask for it. Of a key's several places the one with the smallest
    latitude, then longitude, is taken.
    """
    asked = candidates(facilities) if asked is None else asked
    places = resolver.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("query_key").agg(F.min(F.struct("lat", "lng")).alias("at")).select("query_key", "at.*")
    hits = asked.join(places, "query_key")
    best = hits.groupBy("id").agg(F.min(F.struct("pos", "lat", "lng", "query_key")).alias("b")).select("id", "b.lat", "b.lng", "b.pos", "b.query_key")
    return facilities.select("id").join(best, "id", "left")


def work_list(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """query_key to ask for, each once: the first key of an id that the cache has never seen, unless an earlier one is a hit."""
    seen = three_state(asked, cache)
    first_hit = F.min(F.when(F.col("state") == "hit", F.col("pos")))
    first_new = F.min_by(F.when(F.col("state") == "absent", F.struct("pos", "query_key")), F.when(F.col("state") == "absent", F.col("pos")))
    per_id = seen.groupBy("id").agg(first_hit.alias("hit"), first_new.alias("new"))
    return per_id.where(F.col("new").isNotNull() & (F.col("hit").isNull() | (F.col("new.pos") < F.col("hit")))).select(F.col("new.query_key").alias("query_key")).distinct()


def settle(pending: DataFrame, resolved: DataFrame) -> DataFrame:
    """pending (id, ...) with status ok and coordinates where resolved, else falhou."""
    return pending.join(resolved.select("id", F.col("lat").alias("new_lat"), F.col("lng").alias("new_lng")), "id", "left").withColumn("status", F.when(F.col("new_lat").isNotNull(), "ok").otherwise("falhou"))


PROVIDER = "cep string, state string, city string, neighborhood string, street string, location struct<coordinates:struct<latitude:string,longitude:string>>"


def parse_provider(replies: DataFrame) -> DataFrame:
    """cep, cidade, uf, lat, lng of a provider's JSON replies (column reply); empty texts and coordinates are null, and zero is a coordinate."""
    r = replies.select(F.from_json("reply", PROVIDER).alias("r")).where("r.cep IS NOT NULL")
    return r.select(F.regexp_replace("r.cep", r"\D", "").alias("cep"), F.nullif("r.city", F.lit("")).alias("cidade"), F.nullif("r.state", F.lit("")).alias("uf"), *[F.col(f"r.location.coordinates.{c}").try_cast("double").alias(n) for c, n in (("latitude", "lat"), ("longitude", "lng"))])


def postal_cascade(asked: DataFrame, cache: DataFrame, provider: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers for asked (cep): the cache's, else the provider's, with fonte; and the cache with the provider's rows it lacked."""
    columns = ["cidade", "uf", "lat", "lng"]
    wanted = asked.select("cep").distinct()
    hit = wanted.join(cache.select("cep", *columns), "cep").withColumn("fonte", F.lit("cache"))
    missing = wanted.join(cache.select("cep"), "cep", "left_anti")
    fetched = missing.join(provider.select("cep", *columns), "cep")
    none = missing.join(provider.select("cep"), "cep", "left_anti")
    answers = hit.unionByName(fetched.withColumn("fonte", F.lit("provider"))).unionByName(none.withColumn("fonte", F.lit("none")), allowMissingColumns=True)
    return answers, insert_missing(cache.select("cep", *columns), fetched.select("cep", *columns), ["cep"], [F.col("cidade"), F.col("uf")])


def memoised(asked: DataFrame, resolver: DataFrame) -> DataFrame:
    """asked (id, query_key) with lat, lng and lookups: how many of the resolver's rows were read for the key, whoever asks for it and however often.

    Of a key's several places the one with the smallest latitude, then longitude, is taken.
    """
    once = asked.select("query_key").distinct()
    found = resolver.select("query_key", "lat", "lng", F.lit(True).alias("_read"))
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    answers = once.join(found, "query_key", "left").groupBy("query_key").agg(F.min(F.when(placed, F.struct("lat", "lng"))).alias("at"), F.count("_read").alias("lookups")).select("query_key", "at.lat", "at.lng", "lookups")
    return asked.join(answers, "query_key")


def usage(lookups: DataFrame) -> DataFrame:
    """query_key, hits, last_hit of lookups (query_key, ts, state)."""
    return lookups.where("state = 'hit'").groupBy("query_key").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_hit"))


def count_usage(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """The cache with its counters (hit_count, ultimo_hit) after lookups: hits are added, and the later of both times stays."""
    used = usage(lookups).select("query_key", F.col("hits").alias("_hits"), F.col("last_hit").alias("_last"))
    counted = cache.join(used, "query_key", "left")
    return counted.withColumns({"hit_count": F.col("hit_count") + F.coalesce("_hits", F.lit(0)), "ultimo_hit": F.greatest("ultimo_hit", "_last")}).select(*cache.columns)


def purge_misses(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("lat").isNotNull())


def store(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with rows (query_key, lat, lng, fonte, ts): the last write of a key wins."""
    return upsert(cache, rows, ["query_key"], [F.col("ts")])


def store_bucketed(cache: DataFrame, name: str, path: str, key: str = "query_key", buckets: int = 16) -> None:
    """Writes a cache as a table bucketed and sorted by its key: joins on the key don't shuffle it again."""
    cache.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def merge_bucketed(name: str, rows: DataFrame, path: str, key: str = "query_key", ts: str = "ts", buckets: int = 16) -> None:
    """Puts rows (the last by ts of each key) into a bucketed cache, as upsert does; only rows are shuffled. The table is written anew at path and then takes the old one's place."""
    spark = rows.sparkSession
    table = spark.table(name)
    columns = [c for c in table.columns if c != key]
    new = rows.groupBy(key).agg(F.max_by(F.struct(*columns), ts).alias("_new"))
    both = table.withColumn("_had", F.lit(True)).join(new, key, "full_outer")
    merged = both.select(key, *[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in columns])
    merged.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(f"{name}_next")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
