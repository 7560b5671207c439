"""Balancing batches on a stream of reports: wait for all members, hand out, keep the rest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.positions import id_positions
from batchloom.operators.sharding import balance_batches
from batchloom.session import cut
from batchloom.streaming.streams import newest, run_batches


def stream_barrier_balance(
    spark: SparkSession,
    reports: DataFrame,
    path: str,
    producer: str,
    batch: str,
    members: DataFrame,
    ended: str | None = None,
    checkpoint: str | None = None,
) -> None:
    """Per micro-batch: queue the batches; when every member has reported since the last time that something was
    handed out, or is at its end, balance and hand out all that waits.

    Rows in which the boolean column ``ended`` is true are end marks and hold no batch. Members that ended get batches
    like the others. ``batch`` is a unique integer that follows the order of the reports.

    A micro-batch appends its own reports to ``queued`` and ``seen``. When it hands out, it writes ``handed`` and, to ``left``, what is left over, fewer
    batches than there are members. What waits is the newest of ``left`` and what was queued after it, so nothing old is written again.
    """
    expected = members.select(producer).distinct()
    queue_schema, seen_schema = reports.select(producer, batch).schema, f"{producer} {dict(reports.dtypes)[producer]}, reported boolean, ended boolean, batch int"

    def each(rows: DataFrame, batch_id: int) -> None:
        mark = F.coalesce(F.col(ended), F.lit(False)) if ended else F.lit(False)
        rows.where(~mark).select(producer, batch).write.mode("overwrite").parquet(f"{path}/queued/batch={batch_id}")
        seen = rows.groupBy(producer).agg(F.bool_or(~mark).alias("reported"), F.bool_or(mark).alias("ended"))
        seen.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        last = newest_left(spark, path, batch_id)
        every = spark.read.schema(seen_schema).parquet(f"{path}/seen").where(F.col("batch") <= batch_id)
        ready = every.where(F.col("ended") | (F.col("reported") & (F.col("batch") > last)))
        if not expected.join(ready, producer, "left_anti").isEmpty():
            return
        queue = waiting_since(spark, path, last, batch_id, queue_schema)
        shared = cut(balance_batches(id_positions(queue, batch, [producer], "_pos"), producer, "_pos", expected))
        handed = shared.where(F.col("consumer").isNotNull()).select(producer, batch, "consumer")
        if handed.isEmpty():  # fewer batches than members
            return
        handed.write.mode("overwrite").parquet(f"{path}/handed/batch={batch_id}")
        left = shared.where(F.col("consumer").isNull()).select(producer, batch)
        left.write.mode("overwrite").parquet(f"{path}/left/batch={batch_id}")

    run_batches(reports, each, "balance", checkpoint)


def newest_left(spark: SparkSession, path: str, before: int) -> int:
    """The last micro-batch before ``before`` that handed out, or -1. It is found by the names of files, as it may have left nothing."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/left")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    number = F.regexp_extract("path", "/batch=([0-9]+)/", 1).cast("int")
    return files.select(number.alias("n")).where(F.col("n") < before).agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0]


def waiting_since(spark: SparkSession, path: str, last: int, upto: int, schema) -> DataFrame:
    """What micro-batch ``last`` left over, and what was queued after it up to ``upto``."""
    queued = spark.read.schema(schema).option("basePath", f"{path}/queued").parquet(*[f"{path}/queued/batch={n}" for n in range(last + 1, upto + 1)])
    if last < 0:
        return queued.drop("batch")
    return queued.drop("batch").unionByName(spark.read.schema(schema).parquet(f"{path}/left/batch={last}"))


def still_waiting(spark: SparkSession, path: str) -> DataFrame:
    """The batches that wait after the newest micro-batch."""
    upto = newest_number(spark, f"{path}/queued")
    last = newest_left(spark, path, upto + 1)
    schema = spark.read.parquet(f"{path}/queued").drop("batch").schema
    return waiting_since(spark, path, last, upto, schema)


def newest_number(spark: SparkSession, path: str) -> int:
    return spark.range(1).select(newest(spark, path, "batch")).first()[0]
