"""Stored tables: what is written again, what a repeated batch does, sketches against exact figures, and the limiter in slices."""

import itertools
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import metrics, stored, tables
from waymark.streaming import streams

CUR = "id int, uf string, municipio string, unidade string, cnes string, endereco string, lat double, lng double, geocode_fonte string, geocode_em timestamp"
INC = "seq int, uf string, municipio string, unidade string, cnes string, endereco string"


def files(path):
    """The table's files with their times."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/_" not in d}


def table_of(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "uf", "unidade", "endereco", "lat").collect())


@pytest.fixture
def kept(spark, tmp_path):
    rows = [(1, "SP", "a", "u1", "1", "x", 1.0, 2.0, None, None), (2, "SP", "a", "u2", "2", "y", 1.0, 2.0, None, None), (3, "RJ", "b", "u3", "3", "z", 1.0, 2.0, None, None), (4, "MG", "c", "u4", "4", "w", 1.0, 2.0, None, None)]
    at = str(tmp_path / "stored")
    tables.write_partitions(spark.createDataFrame(rows, CUR), at, "uf")
    return at


def test_only_the_states_of_a_snapshot_are_written(spark, kept, tmp_path):
    before = files(kept)
    batch = spark.createDataFrame([(1, "SP", "a", "u1", "1", "moved"), (2, "SP", "a", "u5", "5", "n"), (3, "RJ", "b", "u3", "3", "z")], INC)
    streams.merge_snapshot(batch, 0, kept, str(tmp_path / "log"))
    want = [(1, "SP", "u1", "moved", None), (3, "RJ", "u3", "z", 1.0), (4, "MG", "u4", "w", 1.0), (5, "SP", "u5", "n", None)]
    assert table_of(spark, kept) == want
    after = files(kept)
    assert {f: t for f, t in before.items() if "uf=MG" in f} == {f: t for f, t in after.items() if "uf=MG" in f}
    assert not {f for f in before if "uf=MG" not in f} & set(after)
    streams.merge_snapshot(batch.limit(0), 0, kept, str(tmp_path / "log"))  # a batch's number counts, and it is done
    assert files(kept) == after
    # broken off before its mark: the same changes again
    stored.remove(spark, str(tmp_path / "log/applied/batch=0"))
    streams.merge_snapshot(batch, 0, kept, str(tmp_path / "log"))
    assert table_of(spark, kept) == want
    streams.merge_snapshot(batch.limit(0), 1, kept, str(tmp_path / "log"))  # a snapshot of no state
    assert table_of(spark, kept) == want


def test_a_state_that_is_emptied_goes(spark, kept):
    stored.rewrite(spark.read.parquet(kept).where("id = 1"), kept, "uf", ["SP", "RJ"])
    assert [r[:2] for r in table_of(spark, kept)] == [(1, "SP"), (4, "MG")] and set(stored.partitions(spark, kept, "uf")) == {"SP", "MG"}
    one = spark.createDataFrame([(9, None, "a", "u", "1", "x", None, None, None, None)], CUR)
    stored.rewrite(one, kept, "uf", [None])
    assert stored.of_partitions(spark.read.parquet(kept), "uf", [None]).count() == 1 and set(stored.partitions(spark, kept, "uf")) == {"SP", "MG", None}


def test_a_stream_of_snapshots(spark, kept, tmp_path):
    for i, rows in enumerate([[(1, "SP", "a", "u1", "1", "x")], [(1, "RJ", "b", "u9", "9", "z"), (2, "RJ", "b", "u9", "9", "z")]]):
        spark.createDataFrame(rows, INC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(os.path.join(tmp_path / "in", f) for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")), (i, i)) if i == 0 else None
    stream = spark.readStream.schema(INC).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.merge_batches(stream, kept, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert table_of(spark, kept) == [(1, "SP", "u1", "x", 1.0), (4, "MG", "u4", "w", 1.0), (5, "RJ", "u9", "z", None), (6, "RJ", "u9", "z", None)]


def test_retention_drops_days_and_rewrites_one(spark, tmp_path):
    at = str(tmp_path / "log")
    log = spark.sql("SELECT id, TIMESTAMP '2024-03-01 00:30:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS criado_em FROM range(96)")
    nothing = spark.createDataFrame([(1000, None)], "id long, criado_em timestamp")
    tables.write_partitions(log.unionByName(nothing).withColumn("dia", F.date_format("criado_em", "yyyy-MM-dd")), at, "dia")
    before = files(at)
    cut = F.lit("2024-03-03 06:00:00").cast("timestamp")
    assert tuple(stored.retain_days(spark, at, cut).first()) == (54, 2, 1)
    left = spark.read.parquet(at)
    assert left.count() == 97 - 54 and left.where("criado_em < TIMESTAMP '2024-03-03 06:00:00'").count() == 0
    after = files(at)
    assert {f for f in before if f in after and before[f] == after[f]} == {f for f in before if "dia=2024-03-04" in f or "HIVE" in f}
    assert tuple(stored.retain_days(spark, at, cut).first()) == (0, 0, 0) and files(at) == after


def test_hours_in_update_mode(spark, tmp_path):
    """Late rows correct an hour while its state is there; a repeated run changes nothing; old hours stay."""
    def add(rows):
        spark.createDataFrame(rows, "t string, status int, ip string, duracao_ms int").select(F.to_timestamp("t").alias("criado_em"), "status", "ip", "duracao_ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("criado_em timestamp, status int, ip string, duracao_ms int").parquet(str(tmp_path / "in"))
        streams.keep_hours(streams.hourly(stream, "1 hour"), str(tmp_path / "hours"), str(tmp_path / "state")).awaitTermination()
        rows = metrics.merged(spark.read.parquet(str(tmp_path / "hours")), F.col("hour")).orderBy("hour").collect()
        return [(str(r["hour"])[:13], r["total"], r["errors"], r["ips"], r["p95_ms"]) for r in rows]

    add([("2024-01-01 10:05:00", 200, "a", 10), ("2024-01-01 10:15:00", 500, "b", 30), ("2024-01-01 23:59:00", 200, "a", 5)])
    first = run()
    assert first == [("2024-01-01 10", 2, 1, 2, 30), ("2024-01-01 23", 1, 0, 1, 5)] and run() == first
    add([("2024-01-01 23:01:00", 404, "c", 7), ("2024-01-02 09:00:00", 200, "a", 1), ("2024-01-01 10:20:00", 200, "d", 1)])  # the last is too late
    assert run() == [("2024-01-01 10", 2, 1, 2, 30), ("2024-01-01 23", 2, 1, 2, 7), ("2024-01-02 09", 1, 0, 1, 1)]


def test_sketches_of_hours_make_a_day(spark):
    log = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, CAST(id % 86400 AS INT)) AS criado_em, CAST(200 + id % 3 * 150 AS INT) AS status, concat('ip', pmod(xxhash64(id), 30000)) AS ip, CAST(pmod(xxhash64(id, 1), 100000) AS INT) AS duracao_ms FROM range(200000)")
    hours = metrics.hour_sketches(log)
    assert hours.count() == 24
    day, exact = metrics.merged(hours).first(), log.agg(F.count_distinct("ip").alias("ips"), F.percentile("duracao_ms", F.array(F.lit(0.945), F.lit(0.955))).alias("p")).first()
    assert (day["total"], day["errors"]) == (200000, log.where("status >= 400").count())
    assert abs(day["ips"] - exact["ips"]) < 0.02 * exact["ips"] and exact["p"][0] <= day["p95_ms"] <= exact["p"][1]
    half = metrics.merged(hours, (F.hour("hour") < 12).alias("am")).collect()  # any span
    assert sum(r["total"] for r in half) == 200000


class Handle:
    """A state store of one value."""

    def __init__(self):
        self.held, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None

    def registerTimer(self, at):
        self.timers.append(at)


def test_limiter_takes_rows_in_slices():
    """A million rows of one address: never more than one slice is held, and the state is one number."""
    handle, counter, open_slices = Handle(), streams.WindowCounter(15, 60), []

    def slices():
        for i in range(1000):
            assert len(open_slices) == i  # the one before has been given out
            yield pd.DataFrame({"id": range(1000 * i, 1000 * i + 1000), "criado_em": pd.Timestamp("2024-01-01")})

    counter.init(handle)
    total = allowed = 0
    for out in counter.handleInputRows(("a", 7), slices(), None):
        open_slices.append(1)
        assert out.n.tolist() == list(range(total + 1, total + 1001))
        total, allowed = total + len(out), allowed + int(out.allowed.sum())
    assert (total, allowed, handle.held, handle.timers) == (1_000_000, 15, (1_000_000,), [480_000])
    more = pd.concat(counter.handleInputRows(("a", 7), iter([pd.DataFrame({"id": [1], "criado_em": [pd.Timestamp("2024-01-01")]})]), None))
    assert more.n.tolist() == [1_000_001] and not more.allowed.any() and more.remaining.tolist() == [0] and len(handle.timers) == 1
    assert list(counter.handleExpiredTimer(("a", 7), None, None)) == [] and not handle.exists()


def test_many_rows_of_one_address_on_a_stream(spark, tmp_path):
    spark.range(300_000).select("id", F.lit("a").alias("ip"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 60).alias("criado_em")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ip string, criado_em timestamp").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.limit_requests(stream, seconds=120).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).groupBy(F.floor(F.unix_millis("criado_em") / 120_000)).agg(F.count("*"), F.count_if("allowed"), F.max("n"), F.count_distinct("n")).collect()
    assert sum(r[1] for r in got) == 300_000 and all(r[2] == 15 and r[1] == r[3] == r[4] for r in got)


def test_ids_of_many_inserts(spark, monkeypatch):
    from waymark.operators import merge

    monkeypatch.setattr(merge, "SLICE_ROWS", 100)
    kinds = "op string, id int, seq int, uf string, municipio string, unidade string, cnes string"
    changes = spark.createDataFrame([("insert", None, 7 * i % 1009, "SP", "m", "u", "c") for i in range(1009)], kinds)
    got = merge.number_inserts(changes, 50).orderBy("seq").collect()
    assert [r["id"] for r in got] == list(range(50, 50 + 1009)) and all(a["seq"] <= b["seq"] for a, b in itertools.pairwise(got))
