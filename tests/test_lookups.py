"""Resolver in tasks, bucketed caches, the stored index and requests in bulk: what is asked, shuffled and read, and results against the plain forms."""

import functools
import io
import re
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.operators import index, lookup, resolver, search
from waymark.plans import registry

FAC = "id int, uf string, municipio string, unidade string, endereco string, cnes string, atendimentos_raw string, lat double, lng double"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue().split("Initial Plan")[0]


@pytest.fixture(scope="module")
def facilities(spark):
    rows = [(i, ["SP", "RJ"][i % 2], ["São Paulo", "Bom Jesus", "Itu"][i % 3], f"Hospital {i % 5} Ñandú", None if i % 7 == 0 else f"Rua {i % 4}, {i}", None, "Botrópico" if i % 2 else "", None, None) for i in range(60)]
    return spark.createDataFrame(rows, FAC)


def counted(log, key):
    """A provider that writes down every call, and behaves badly in many ways."""
    with open(log, "a") as f:
        f.write(key + "\n")
    if key.startswith("Rua 1"):
        raise OSError("no network")
    return {"2": ("x", None), "3": (float("nan"), 1.0), "B": None, "S": (-23.0, -46.0), "I": (1, 2, 3)}.get(key[4] if key.startswith("Rua") else key[0], (10, 20))


def test_faulty_provider(spark, facilities, tmp_path):
    log = str(tmp_path / "calls")
    cache = spark.createDataFrame([("Rua 0, 4, Bom Jesus, SP, Brasil", 5.0, 6.0), ("Itu, RJ, Brasil", None, None)], "query_key string, lat double, lng double")
    got, answers = resolver.resolve(facilities, functools.partial(counted, log), str(tmp_path / "answers"), cache, tries=2)
    got = {r["id"]: (r["lat"], r["lng"], r["pos"]) for r in got.collect()}
    assert set(got) == set(range(60))
    assert got[4] == (5.0, 6.0, 0) and got[0] == (-23.0, -46.0, 2) and got[8] == (10.0, 20.0, 0)
    assert got[7] == got[14] == (None, None, None)  # a city that the provider does not know, one that it answers with three numbers
    assert got[5] == (10.0, 20.0, 1)  # the address fails, the street is found
    calls = open(log).read().split("\n")[:-1]
    outcome = {r["query_key"]: (r["outcome"], r["tries"]) for r in answers.collect()}
    assert {k: calls.count(k) for k in calls} == {k: n for k, (_, n) in outcome.items()}  # each key once, failing ones twice
    assert outcome["Bom Jesus, SP, Brasil"] == ("miss", 1) and outcome["Itu, SP, Brasil"] == ("failed", 2)
    assert "Itu, RJ, Brasil" not in outcome and "Rua 0, 4, Bom Jesus, SP, Brasil" not in outcome
    answers.count()
    assert len(open(log).read().split("\n")) == len(calls) + 1  # reading answers asks nothing
    none, _ = resolver.resolve(facilities.where("false"), functools.partial(counted, log), str(tmp_path / "none"))
    assert none.count() == 0


def test_a_bucketed_cache_is_not_shuffled(spark, facilities, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("query_key"), F.when(F.col("id") % 3 > 0, F.lit(1.0)).alias("lat"), F.lit(2.0).alias("lng"), F.lit(0).cast("long").alias("ts"))
        lookup.store_bucketed(cache, "cache_of_test", str(tmp_path / "0"), buckets=4)
        keys = spark.range(900, 1100).select(F.concat(F.lit("k"), "id").alias("query_key"))
        states = lookup.three_state(keys, spark.table("cache_of_test"))
        plan = plan_of(states)
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the keys' side alone
        assert {r["state"]: r["count"] for r in states.groupBy("state").count().collect()} == {"absent": 100, "miss": 34, "hit": 66}
        new = spark.createDataFrame([("k5", 7.0, 8.0, 2), ("k5", 6.0, 8.0, 1), ("new", 9.0, 9.0, 1)], "query_key string, lat double, lng double, ts long")
        table = spark.table("cache_of_test")
        lookup.merge_bucketed("cache_of_test", new, str(tmp_path / "1"), buckets=4)
        table = spark.table("cache_of_test")
        assert table.count() == 1001 and [tuple(r) for r in table.where("query_key IN ('k5', 'new')").select("query_key", "lat").orderBy("query_key").collect()] == [("k5", 7.0), ("new", 9.0)]
        assert "Bucketed: true" in plan_of(lookup.three_state(keys, table)) and plan_of(lookup.three_state(keys, table)).count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS cache_of_test")


def test_stored_index(spark, tmp_path):
    """The same as the plain index, from lists that only the rarest term's ranges are read of."""
    rows = spark.range(3000).select(F.col("id"), F.explode(F.array(F.lit("all"), F.concat(F.lit("m"), F.col("id") % 7), F.concat(F.lit("n"), F.col("id") % 11), F.when(F.col("id") < 5, "rare"))).alias("term")).where("term IS NOT NULL")
    rows = rows.unionByName(rows.limit(10))
    index.build(rows, "index_of_test", str(tmp_path), span=100, buckets=4)
    try:
        asked = spark.createDataFrame([(1, "all"), (1, "m3"), (1, "n4"), (1, "n4"), (2, "rare"), (2, "all"), (3, "rare"), (3, "gone"), (4, "m1"), (5, None), (6, "m1"), (6, "m2")], "query_id int, term string")
        got = sorted(tuple(r) for r in index.find_all(asked, "index_of_test").collect())
        plain = search.find_all(asked.where("term IS NOT NULL").withColumnRenamed("term", "token"), rows.distinct().withColumnRenamed("term", "token"))
        assert got == sorted(tuple(r) for r in plain.collect()) and {q for q, _ in got} == {1, 2, 4}
        terms = {r["query_id"]: r["first"] for r in index.ordered_terms(asked, "index_of_test").collect()}
        assert terms == {1: "n4", 2: "rare", 4: "m1", 6: "m1"}  # m1 and m2 are equally many; query 3 has a term that nothing has
        assert spark.table("index_of_test").agg(F.max(F.size("ids"))).first()[0] <= 100
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = index.ordered_terms(asked, "index_of_test").join(spark.table("index_of_test"), F.col("first") == F.col("term"))
        scan = re.findall(r"FileScan parquet spark_catalog\.default\.index_of_test\[.*?Bucketed: (\w+)", plan_of(found))
        assert scan == ["true"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.drop(spark, "index_of_test")


def test_rows_of_pairs_are_bounded():
    """Equal queries with many identifiers come in rows of some thousand pairs, as Spark holds all pairs of a row at once; none is lost or comes twice."""
    lists = {"a": np.arange(0, 60_000, 2), "b": np.arange(0, 60_000, 3)}
    asks = [(q, ["a", "b"]) for q in range(300)] + [(300, ["b"])]
    columns = {
        "span": pa.array([0] * 303, pa.int64()), "slice": pa.array([0] * 303, pa.int64()), "asks": pa.array([False] * 2 + [True] * 301),
        "terms": pa.array([["a"], ["b"], *[t for _, t in asks]]), "ids": pa.array([*lists.values(), *[None] * 301], pa.list_(pa.int64())), "query_id": pa.array([None] * 2 + [q for q, _ in asks], pa.int32()),
    }
    rows = [r for batch in index._intersected(iter([pa.RecordBatch.from_pydict(columns)])) for r in batch.to_pylist()]
    assert max(len(r["queries"]) * len(r["ids"]) for r in rows) <= 20_000
    got = sorted((q, i) for r in rows for q in r["queries"] for i in r["ids"])
    assert got == [(q, i) for q in range(300) for i in range(0, 60_000, 6)] + [(300, i) for i in range(0, 60_000, 3)]


def test_postings_are_made_by_all_tasks(spark, monkeypatch):
    """A table of one small file would be folded by one task."""
    given = []
    monkeypatch.setattr(index, "build", lambda postings, *a: given.append(postings))
    monkeypatch.setattr(index, "find_all", lambda asked, name: asked)
    registry.QUERIES["o61_stored_index"](spark, "/root/testdata/sf0.001")
    assert given[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_requests_in_bulk(spark, facilities):
    """Each request as `directory` answers it."""
    asks = [("sp", None, None, None, None, None), (None, "SAO", None, None, 5, 2), (None, None, "jararaca", "ñan", 500, 0), ("RJ", "bom", None, "rua 1", None, None), (None, None, None, "h", 3, 1), (None, None, None, "RUA", 700, None), (None, "", None, "tal 4 ñ", None, None), (None, "u", "jararaca", None, 1, 0), (None, None, None, "nothing has this", None, None), ("SP", None, None, None, 0, None)]
    bad = [(None, None, None, None, None, None), ("SP", None, "unknown", None, None, None), ("SP", None, None, None, -1, None), ("SP", None, None, None, None, -1), ("", "", None, "", None, None)]
    rows = [(i, *a) for i, a in enumerate([*asks, *bad, asks[0]])]
    requests = spark.createDataFrame(rows, "request_id int, uf string, city string, service string, q string, limit int, offset int")
    got = {}
    for r in search.directory_many(requests, facilities).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
        assert r["rank"] == len(got[r["request_id"]])
    want = {}
    for i, uf, city, service, q, limit, offset in rows:
        if len(asks) <= i < len(asks) + len(bad):
            continue
        ids = [r["id"] for r in search.directory(facilities, uf, city, service, q, 100 if limit is None else limit, offset or 0).collect()]
        if ids:
            want[i] = ids
    assert got == want
    assert search.directory_many(requests.where("false"), facilities).count() == 0
