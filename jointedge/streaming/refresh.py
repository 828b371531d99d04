"""Incremental refresh and the reuse of priced requests as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def new_rows(stream: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("gid", "p"), delay: str = "7 days") -> DataFrame:
    """Each game row once: repeats within the watermark are dropped, and its state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def moments_of(rows: DataFrame) -> DataFrame:
    """Additive sums per season and entity of a 0/1 pair (h1, h2)."""
    return rows.groupBy("season", "p").agg(F.count("*").alias("n"), F.sum("h1").alias("n1"), F.sum("h2").alias("n2"), F.sum(F.col("h1") * F.col("h2")).alias("n11"))


def keep_moments(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's sums under its batch id, so a batch that runs again replaces itself; totals are sums over batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        moments_of(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_moments(batches: DataFrame) -> DataFrame:
    return batches.groupBy("season", "p").agg(*(F.sum(k).alias(k) for k in ("n", "n1", "n2", "n11")))


class SeasonMoments:
    """Additive sums by season and entity that are kept up to date one season at a time.

    ``path/season=S/through=B`` holds a season's sums over all batches up to B; the version with the largest B counts. A batch reads and writes only the
    seasons that it has rows of, and those as new folders that appear whole when its job is committed, so readers always
    find a complete version. A batch that runs again starts from what was there before it, so nothing counts twice; for that the version
    before the newest stays, older ones go.
    """

    KEYS, SUMS = ["season", "p"], ["n", "n1", "n2", "n11"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, folder: str, key: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{key}="))

    def versions(self, season: int) -> list[int]:
        """The batches through which a season's sums are kept, oldest first."""
        return self._listed(f"{self.path}/season={season}", "through")

    def read(self, seasons: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The sums of the given seasons, or all; ``before``: as they were before a batch. Only their newest folders are read."""
        found = []
        for season in self._listed(self.path, "season") if seasons is None else seasons:
            held = [v for v in self.versions(season) if before is None or v < before]
            found += [f"{self.path}/season={season}/through={held[-1]}"] if held else []
        schema = "season int, p long, n long, n1 long, n2 long, n11 long"
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, through long").option("basePath", self.path).parquet(*found).select(*self.KEYS, *self.SUMS)

    def apply(self, rows: DataFrame, batch: int) -> list[int]:
        """Adds the rows of a batch (see ``moments_of``) and returns the seasons that changed."""
        new = moments_of(rows).withColumn("season", F.col("season").cast("int")).withColumn("p", F.col("p").cast("long")).persist()
        try:
            seasons = sorted(r.season for r in new.select("season").distinct().collect())
            if seasons:
                merged = new.select(*self.KEYS, *self.SUMS).unionByName(self.read(seasons, batch)).groupBy(*self.KEYS).agg(*(F.sum(k).alias(k) for k in self.SUMS))
                out = merged.withColumn("through", F.lit(batch)).repartition("season", F.pmod(F.hash("p"), F.lit(16)))
                out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "through").parquet(self.path)
        finally:
            new.unpersist()
        for season in seasons:
            for old in self.versions(season)[:-2]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/season={season}/through={old}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return seasons

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies each batch of a stream of rows under its batch id."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Reuse(StatefulProcessor):
    """Per fingerprint the time of the success that is kept, with a timer at the end of its life."""

    def __init__(self, life_us: int):
        self.life = life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["us", "request_id"], kind="stable")  # a fingerprint's rows of one batch
        times, good = asked["us"].to_numpy(np.int64), asked["ok"].to_numpy(bool)
        since = np.full(times.size, -1, np.int64)
        held = self.kept.get()[0] if self.kept.exists() else None
        successes, at = np.flatnonzero(good), 0
        while at < times.size:
            if held is not None and times[at] - held < self.life:
                end = int(np.searchsorted(times, held + self.life))  # all up to then are answered by what is kept
                since[at:end] = held
                at = end
            else:  # the next success is kept from here on; failures before it are not
                k = int(np.searchsorted(successes, at))
                if k == successes.size:
                    break
                at, held = int(successes[k]) + 1, int(times[successes[k]])
        if held is not None and held != (self.kept.get()[0] if self.kept.exists() else None):
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.kept.update((held,))
            self.handle.registerTimer((held + self.life) // 1000)
        cached = since >= 0
        yield pd.DataFrame({"request_id": asked["request_id"].to_numpy(), "fingerprint": key[0], "cached": cached, "age_s": np.where(cached, (times - since + 500_000) // 1_000_000, 0)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def reused_requests(stream: DataFrame, life: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """request_id, fingerprint, cached and age_s (whole seconds) for each request (request_id, ts, fingerprint, ok).

    The first success of a fingerprint is kept for ``life``: requests within it are answered from it, with its age. Later ones are priced anew, and
    a failure is not kept. A fingerprint's requests count in the order of their time within a batch; its state goes by a timer once
    the watermark (``delay`` behind the newest request) has passed the end of its life, so the state holds fingerprints of the last minutes only.
    Needs the RocksDB state store.
    """
    life_us = int(pd.Timedelta(life).total_seconds() * 1_000_000)
    rows = stream.select("request_id", "ts", F.unix_micros("ts").alias("us"), "fingerprint", F.coalesce("ok", F.lit(False)).alias("ok")).withWatermark("ts", delay)
    return rows.groupBy("fingerprint").transformWithStateInPandas(_Reuse(life_us), "request_id long, fingerprint string, cached boolean, age_s long", "Append", "EventTime")


def keep_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is final to a table; the sink's log makes a batch that runs again count once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, path: str, to: str) -> DataFrame:
    """The totals of all batches so far as one folder in place of one per batch; further batches are added to these by ``total_moments``."""
    total_moments(spark.read.parquet(path)).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def fresh_requests(stream: DataFrame, life: str = "10 minutes") -> DataFrame:
    """Price requests (ts, fingerprint), each fingerprint once within its life."""
    return stream.withWatermark("ts", life).dropDuplicatesWithinWatermark(["fingerprint"])


def requests_per_window(stream: DataFrame, life: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", life).groupBy(F.window("ts", life), "fingerprint").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "fingerprint", "n")
