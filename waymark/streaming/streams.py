"""The log and snapshot operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from waymark.functions import logs
from waymark.operators import merge, metrics, stored

#: Spark's state store for transformWithState.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Into how many slices the limiter puts its addresses.
SLICES = 256


def shape(log: DataFrame, salt: str) -> DataFrame:
    """Raw log fields as they are stored; stateless, so the same on a stream."""
    return log.select(
        F.col("criado_em"),
        logs.route(F.col("path")).alias("rota"),
        F.coalesce("method", F.lit("GET")).alias("metodo"),
        F.col("status").cast("int").alias("status"),
        logs.ip_hash(F.col("ip"), salt).alias("ip_hash"),
        logs.text_field(F.col("user_agent"), 256).alias("user_agent"),
        logs.text_field(F.col("message"), 500).alias("erro_msg"),
        logs.flag(F.col("cache_hit")).alias("cache_hit"),
        F.coalesce(F.col("rate_limited"), F.lit(False)).alias("rate_limited"),
    )


def append(stream: DataFrame, path: str, checkpoint: str, by: Column | None = None):
    """Appends a stream to Parquet files by date."""
    dated = stream.withColumn("dia", F.to_date(by if by is not None else F.col("criado_em")))
    return dated.writeStream.format("parquet").outputMode("append").partitionBy("dia").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, late: str = "2 hours", ts: str = "criado_em") -> DataFrame:
    """hour, total, errors, and the sketches of metrics.hour_sketches, of a stream; the state of an hour goes when the watermark passes its end.

    In append mode an hour is given once, when it is over by `late`; in update mode at each change, with all of its rows so far.
    """
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("errors"), *metrics.sketches(stream.columns))
        .select(F.col("w.start").alias("hour"), "total", "errors", *metrics.sketch_names(stream.columns))
    )


def keep_hours(hours: DataFrame, path: str, checkpoint: str):
    """Keeps the hours of a stream in update mode in a table stored by day: a micro-batch writes the days that it has hours of, each of its hours in the place of the one before.

    An update has an hour's whole figures, so a batch that is repeated changes nothing; hours whose state is gone stay as they were.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("dia", F.date_format("hour", "yyyy-MM-dd")).persist()
        days = [r[0] for r in new.select("dia").distinct().collect()]  # of one batch
        rows = new
        if stored.exists(spark, path):
            before = stored.of_partitions(spark.read.schema(new.schema).parquet(path), "dia", days)
            rows = new.unionByName(before.join(new.select("hour"), "hour", "left_anti"))
        if days:
            stored.rewrite(rows, path, "dia", days)
        new.unpersist()

    return hours.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class WindowCounter(StatefulProcessor):
    """Counts the requests of an address in a window. Its state is one number, and rows come and go in slices, however many there are."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else None
        if before is None:
            self.handle.registerTimer((int(key[1]) + 1) * self.seconds * 1000)
        n = before or 0
        for part in rows:
            places = np.arange(n + 1, n + len(part) + 1)
            n += len(part)
            yield pd.DataFrame({"id": part["id"], "ip": key[0], "criado_em": part["criado_em"], "n": places, "allowed": places <= self.limit, "remaining": np.maximum(0, self.limit - places)})
        self.count.update((n,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


class SliceCounter(StatefulProcessor):
    """Counts the requests of a slice of the addresses, each in its windows. A micro-batch reads and writes a slice's counts once, however many addresses and windows it has.

    The state has a number for each address and window that is open, of the slice's addresses alone; windows go when the watermark has passed their ends.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "bucket array<bigint>, ip array<string>, n array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = self._read()
        last = None
        for part in rows:
            number, firsts = self._windows(part)
            own = list(zip(part["bucket"].to_numpy()[firsts].tolist(), (None if pd.isna(v) else v for v in part["ip"].to_numpy()[firsts]), strict=True))
            before = np.array([counts.get(w, 0) for w in own], "i8")
            counts.update(zip(own, (before + np.bincount(number)).tolist(), strict=True))
            places = before[number] + part.groupby(number).cumcount().to_numpy() + 1
            last = max(b for b, _ in own) if last is None else max(last, *(b for b, _ in own))
            yield pd.DataFrame({"id": part["id"], "ip": part["ip"], "criado_em": part["criado_em"], "n": places, "allowed": places <= self.limit, "remaining": np.maximum(0, self.limit - places)})
        self._write(counts, timerValues)
        if last is not None:
            self.handle.registerTimer((last + 1) * self.seconds * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._write(self._read(), timerValues)
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _windows(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its address and window, in the order in which they come, and the first row of each number."""
        ip, _ = pd.factorize(part["ip"], use_na_sentinel=False)
        number, _ = pd.factorize(pd.MultiIndex.from_arrays([part["bucket"].to_numpy(), ip]))
        return number, np.unique(number, return_index=True)[1]

    def _read(self) -> dict:
        if not self.counts.exists():
            return {}
        bucket, ip, n = self.counts.get()
        return dict(zip(zip(bucket, ip, strict=True), n, strict=True))

    def _write(self, counts: dict, timerValues) -> None:
        """Rows that came before the watermark of this batch are counted by now, and later batches have none of them: so windows that it has passed go."""
        over = timerValues.getCurrentWatermarkInMs() if timerValues is not None else None
        left = counts if over is None else {w: n for w, n in counts.items() if (w[0] + 1) * self.seconds * 1000 > over}
        if left:
            self.counts.update(([b for b, _ in left], [a for _, a in left], list(left.values())))
        elif self.counts.exists():
            self.counts.clear()


def limit_requests(stream: DataFrame, limit: int = 15, seconds: int = 60, late: str = "1 minute", slices: int | None = SLICES) -> DataFrame:
    """id, ip, criado_em, n, allowed, remaining of a stream: each request's place in its address' window, in the order of arrival.

    Counts of open windows are all that is kept, until the watermark passes their ends. Addresses go together in so many slices, so that the cost goes with the rows; a slice's counts
    are held by a task. With slices=None every address and window has a state of its own, which is for few addresses. It needs the state store ROCKS, which is set for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bucket = F.floor(F.unix_millis("criado_em") / (seconds * 1000))
    timed = stream.withWatermark("criado_em", late).select("id", "ip", "criado_em", bucket.alias("bucket"))
    out = "id long, ip string, criado_em timestamp, n long, allowed boolean, remaining long"
    if slices is None:
        return timed.groupBy("ip", "bucket").transformWithStateInPandas(WindowCounter(limit, seconds), out, "append", "EventTime")
    sliced = timed.withColumn("slice", F.pmod(F.xxhash64("ip"), F.lit(slices)))
    return sliced.groupBy("slice").transformWithStateInPandas(SliceCounter(limit, seconds), out, "append", "EventTime")


def merge_snapshot(batch: DataFrame, number: int, path: str, log: str, by: str = "uf") -> None:
    """Merges a snapshot of some partitions (states) into a table stored by them: rows of those that the snapshot lacks are deleted, other partitions' files aren't touched.

    The changes, with the ids of inserted rows, are written under `log` by the batch's number before they are applied, and a mark after. A batch that is repeated does nothing if it has its mark, and
    else applies the same changes again, which is the same as applying them once.
    """
    spark = batch.sparkSession
    changed, mark = f"{log}/changes/batch={number}", f"{log}/applied/batch={number}"
    if stored.exists(spark, mark):
        return
    values = [r[0] for r in batch.select(by).distinct().collect()]  # partitions of the table
    table = spark.read.parquet(path)
    own = stored.of_partitions(table, by, values)
    if not stored.exists(spark, f"{changed}/_SUCCESS"):
        last = table.agg(F.max("id")).first()[0] or 0
        merge.number_inserts(merge.merge(own, batch), last + 1).write.mode("overwrite").parquet(changed)
    changes = spark.read.parquet(changed)
    if values:
        stored.rewrite(merge.apply(own, changes), path, by, values)
    spark.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(mark)


def merge_batches(stream: DataFrame, path: str, log: str, checkpoint: str):
    """Every micro-batch is a snapshot for merge_snapshot."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge_snapshot(batch, number, path, log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
