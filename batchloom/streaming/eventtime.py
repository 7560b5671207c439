"""Sliding and session windows in event time, with a table for the rows that come behind the watermark.

Each micro-batch appends what it adds to its windows; reading merges these parts, so a window is up to date after every batch and none is kept
in memory. The watermark is the newest time of the batches before, less a delay. A row is late when all windows that it could count in have
ended by then; it goes to the side table, once, and to no window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.scalars import epoch_micros
from batchloom.streaming.leases import merged_intervals
from batchloom.streaming.streams import run_batches

SECOND = 1_000_000


def _by_watermark(
    spark: SparkSession, rows: DataFrame, path: str, ts: str, delay_seconds: int, reach: Column, parts: Callable[[DataFrame], DataFrame], checkpoint: str | None
) -> None:
    """``reach`` is the time in microseconds at which the last window of a row ends, from ``_us``, the row's own time."""
    newest_schema = "newest bigint, batch int"
    spark.createDataFrame([], "newest bigint").write.mode("ignore").parquet(f"{path}/newest/batch=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(newest_schema).parquet(f"{path}/newest").where(F.col("batch") < batch_id)
        watermark = before.agg((F.max("newest") - delay_seconds * SECOND).alias("w")).first()["w"]
        timed = batch.withColumn("_us", epoch_micros(F.col(ts))).persist()  # read three times below; recomputed where an executor is lost
        late = F.lit(False) if watermark is None else F.coalesce(reach <= watermark, F.lit(False))
        timed.where(late).drop("_us").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        parts(timed.where(~late & F.col("_us").isNotNull())).write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
        timed.agg(F.max("_us").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        timed.unpersist()

    run_batches(rows, each, "windows", checkpoint)


def sliding_sums(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    ts: str,
    keys: list[str],
    sums: dict[str, Column],
    size_seconds: int,
    slide_seconds: int,
    delay_seconds: int,
    checkpoint: str | None = None,
) -> None:
    """Sums of the columns ``sums`` in windows of ``size_seconds`` that start every ``slide_seconds``. Rows without a time are in no window."""
    slide = slide_seconds * SECOND
    reach = F.floor(F.col("_us") / slide) * slide + size_seconds * SECOND
    window = F.window(F.timestamp_micros("_us"), f"{size_seconds} seconds", f"{slide_seconds} seconds")

    def parts(batch: DataFrame) -> DataFrame:
        found = batch.groupBy(window.alias("window"), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        return found.select(F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), *keys, *sums)

    _by_watermark(spark, rows, path, ts, delay_seconds, reach, parts, checkpoint)


def windows_now(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """``(start_us, end_us, keys, sums)`` after all micro-batches."""
    return spark.read.parquet(f"{path}/parts").groupBy("start_us", "end_us", *keys).agg(*[F.sum(n).alias(n) for n in sums])


def sessions(
    spark: SparkSession, rows: DataFrame, path: str, ts: str, key: str, gap_seconds: int, delay_seconds: int, checkpoint: str | None = None
) -> None:
    """Sessions per key: rows that are ``gap_seconds`` apart or less are one session."""
    gap = gap_seconds * SECOND

    def parts(batch: DataFrame) -> DataFrame:
        session = F.session_window(F.timestamp_micros("_us"), f"{gap_seconds} seconds").alias("session")
        found = batch.groupBy(session, key).agg(F.count(F.lit(1)).alias("beats"))
        end = F.unix_micros("session.end")
        return found.select(key, F.unix_micros("session.start").alias("start_us"), end.alias("end_us"), "beats", (end - gap).alias("last_us"))

    _by_watermark(spark, rows, path, ts, delay_seconds, F.col("_us") + gap, parts, checkpoint)


def sessions_now(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(key, start_us, end_us, beats, closed)`` after all micro-batches."""
    return merged_intervals(spark.read.parquet(f"{path}/parts").drop("batch"), key)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The side table of either kind of window."""
    return spark.read.parquet(f"{path}/late").drop("batch")
