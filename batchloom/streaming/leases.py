"""Leases kept alive by beats: alive intervals in batch and in a stream, and expiry events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.scalars import epoch_micros
from batchloom.operators.carry import id_block, with_previous, with_running
from batchloom.streaming.streams import run_batches

DAY_US = 86_400_000_000


def alive_intervals(beats: DataFrame, key: str, ts: str, ttl_seconds: int, order: str, block: Column) -> DataFrame:
    """Intervals in which a key is alive: each beat keeps it for ``ttl_seconds``.

    ``order`` is a column that follows the time. A key that beats very often is cut into blocks.
    """
    at = beats.select(key, order, epoch_micros(F.col(ts)).alias("_us"))
    timed = with_previous(at, {"_us": "_before"}, [key], [order], block)
    gap = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > ttl_seconds * 1_000_000)
    starts = timed.withColumn("_start", F.when(gap, 1).otherwise(0))
    numbered = with_running(starts, F.col("_start"), "_interval", [key], [order], block)
    return numbered.groupBy(key, "_interval").agg(
        F.min("_us").alias("start_us"),
        (F.max("_us") + ttl_seconds * 1_000_000).alias("end_us"),
        F.count(F.lit(1)).alias("beats"),
    ).drop("_interval")


def alive_at(intervals: DataFrame, micros: Column) -> DataFrame:
    """The intervals that cover one moment."""
    return intervals.where((F.col("start_us") <= micros) & (F.col("end_us") > micros))


def merged_intervals(pieces: DataFrame, key: str) -> DataFrame:
    """Intervals ``(key, start_us, end_us, beats)`` from pieces that overlap or touch.

    ``closed`` tells whether a beat of any key is as late as the interval's end, so that nobody can prolong it any more.
    """
    order, block = ["start_us", "end_us"], id_block("start_us", DAY_US)
    whole = pieces.groupBy(key, "start_us", "end_us").agg(F.sum("beats").alias("beats"), F.max("last_us").alias("last_us"))
    reach = with_running(whole, F.col("end_us"), "_reach", [key], order, block, "max", include_current=False)
    starts = F.when(F.col("_reach").isNull() | (F.col("start_us") > F.col("_reach")), 1).otherwise(0)
    numbered = with_running(reach.withColumn("_start", starts), F.col("_start"), "_interval", [key], order, block)
    found = numbered.groupBy(key, "_interval").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("beats").alias("beats")
    )
    return found.withColumn("closed", F.col("end_us") <= pieces.agg(F.max("last_us")).scalar()).drop("_interval")


def watch_leases(beats: DataFrame, log: str, key: str, ts: str, ttl_seconds: int, checkpoint: str | None = None) -> None:
    """The same on a stream: every micro-batch appends its own intervals to ``log``, a repeated one replaces itself.

    :func:`merged_intervals` of the log gives the leases. There is no watermark: late beats join what they touch, and
    open intervals are there too.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        timed = batch.select(key, ts, epoch_micros(F.col(ts)).alias("_at"))
        own = alive_intervals(timed, key, ts, ttl_seconds, "_at", id_block("_at", DAY_US))
        pieces = own.withColumn("last_us", F.col("end_us") - ttl_seconds * 1_000_000)
        pieces.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    run_batches(beats, each, "leases", checkpoint)


def expired_keys(beats: DataFrame, key: str, ts: str, ttl_seconds: int, delay: str) -> DataFrame:
    """Stream of expiries: a key whose last beat is ``ttl_seconds`` behind the watermark, with that beat.

    State per key is one number, and an event-time timer that each beat moves on.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    key_name, ttl_us = key, ttl_seconds * 1_000_000

    class Lease(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "us bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            beats = pd.concat([frame["beat_us"] for frame in rows]).sort_values()
            if self.last.exists():
                beats = pd.concat([pd.Series([self.last.get()[0]]), beats]).sort_values()
            # a silence that began and ended before this batch has no timer of its own
            silent = beats[(beats.shift(-1) - beats) > ttl_us]
            newest = int(beats.iloc[-1])
            self.last.update((newest,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(newest + ttl_us) // 1000))
            yield pd.DataFrame({key_name: [key[0]] * len(silent), "last_us": silent.astype("int64").to_list()})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = self.last.get()[0]
            self.last.clear()
            yield pd.DataFrame({key_name: [key[0]], "last_us": [last]})

        def close(self):
            pass

    us = epoch_micros(F.col(ts))
    timed = beats.select(key, us.alias("beat_us"), F.timestamp_micros(us).alias("beat_at")).withWatermark("beat_at", delay)
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Lease(), outputStructType=f"{key} bigint, last_us bigint", outputMode="append", timeMode="EventTime"
    )
