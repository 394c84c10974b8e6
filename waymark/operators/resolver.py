"""A resolver in tasks: a provider is any function from a key to coordinates, asked where the data is."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import lookup
from waymark.operators.stored import kept

#: A provider's reply is a pair (latitude, longitude) or None for a place that it doesn't know; whatever else it returns or raises counts as a failure.
Provider = Callable[[str], tuple[float, float] | None]
ANSWERS = "query_key string, lat double, lng double, outcome string, tries int"


def _asked_once(provider: Provider, key: str, tries: int, wait: float) -> tuple[float | None, float | None, str, int]:
    """lat, lng, outcome (hit, miss or failed) and the number of calls. Never raises."""
    for n in range(1, tries + 1):
        try:
            reply = provider(key)
            if reply is None:
                return None, None, "miss", n
            lat, lng = (float(x) for x in reply)
            if math.isfinite(lat) and math.isfinite(lng) and abs(lat) <= 90 and abs(lng) <= 180:
                return lat, lng, "hit", n
        except Exception:  # a provider's failure is its answer; the job goes on
            pass
        if n < tries and wait:
            time.sleep(wait * 2 ** (n - 1))
    return None, None, "failed", tries


def ask(keys: DataFrame, provider: Provider, at: str, tries: int = 3, wait: float = 0.0, width: int | None = None) -> DataFrame:
    """ANSWERS for each distinct query_key (null isn't asked), written to `at`, so that no key is asked again when they are read again.

    width: how many tasks ask at once at most, for a provider that limits its callers. A task that is lost asks its keys again.
    """
    spark = keys.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            lat, lng, outcome, n = zip(*(_asked_once(provider, k, tries, wait) for k in names), strict=True) if names else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lat, pa.float64()), pa.array(lng, pa.float64()), pa.array(outcome, pa.string()), pa.array(n, pa.int32())], names=["query_key", "lat", "lng", "outcome", "tries"])

    distinct = keys.where("query_key IS NOT NULL").select("query_key").distinct()
    distinct.repartition(*([width] if width else []), "query_key").mapInArrow(run, ANSWERS).write.parquet(at)
    return spark.read.schema(ANSWERS).parquet(at)


def resolve(facilities: DataFrame, provider: Provider, at: str, cache: DataFrame | None = None, asked: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """id, lat, lng, pos, query_key as lookup.resolve has them, and the provider's answers.

    An id's next candidate is asked for only when those before it have no coordinates, and a key only once, whoever has it and in whatever place; what the cache (query_key, lat, lng)
    has, misses too, isn't asked for. Failed keys stay without coordinates; they are in the answers with their outcome, so that they can be kept out of a cache.
    """
    spark = facilities.sparkSession
    asked = kept(lookup.candidates(facilities) if asked is None else asked, "candidates")  # read for every place
    known = cache.select("query_key", "lat", "lng") if cache is not None else spark.createDataFrame([], "query_key string, lat double, lng double")
    answers = None
    for pos in range((asked.agg(F.max("pos")).first()[0] or 0) + 1):  # a few places
        found = known.where("lat IS NOT NULL AND lng IS NOT NULL").select("query_key")
        settled = asked.where(F.col("pos") < pos).join(found, "query_key", "left_semi").select("id").distinct()
        due = asked.where(F.col("pos") == pos).join(settled, "id", "left_anti").join(known.select("query_key"), "query_key", "left_anti")
        new = ask(due, provider, f"{at}/place={pos}", **how)
        known = known.unionByName(new.select("query_key", "lat", "lng"))
        answers = new if answers is None else answers.unionByName(new)
    return lookup.resolve(facilities, known, asked), answers
