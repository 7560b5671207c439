"""Parts of a stream that end at a marker: what comes after it is set aside, and one row tells when all parts have ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.session import cut
from batchloom.streaming.streams import run_batches

ROW, LATE, MARKER, END = "row", "late", "marker", "end"


def close_parts(
    spark: SparkSession, rows: DataFrame, path: str, part: str, order: str, marker: Column, parts: DataFrame, checkpoint: str | None = None
) -> None:
    """Follow the stream ``rows`` until the ``parts`` (a table with the column ``part``) have ended, and beyond.

    The first row of a part that is a ``marker``, by ``order`` within its micro-batch, closes the part. Rows after it in that order, and all rows
    that arrive in later micro-batches, are late. Each micro-batch is written once, with the column ``kind``: ``row``, ``late``, ``marker``, and a single
    row ``end`` in the batch in which the last part has ended. Only markers are kept between batches: one small row for each part that has
    ended, which Spark joins to the rows of a batch by broadcast, so a part with most of the rows is spread over all tasks.
    A micro-batch that is repeated writes the same again.
    """
    marks = f"{path}/markers"
    kinds = dict(rows.dtypes)
    known_schema = f"`{part}` {kinds[part]}, ending {kinds[order]}, batch int"
    spark.createDataFrame([], known_schema).drop("batch").write.mode("ignore").parquet(f"{marks}/batch=-1")
    expected = parts.select(part).distinct()

    def each(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(known_schema).parquet(marks).where(F.col("batch") < batch_id).select(part, "ending")
        found = batch.where(marker).groupBy(part).agg(F.min(order).alias("ending")).join(known, part, "left_anti")
        found.write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        found = spark.read.schema(known_schema).parquet(f"{marks}/batch={batch_id}").select(part, "ending")
        closed = known.select(part, "ending", F.lit(True).alias("before")).unionByName(found.withColumn("before", F.lit(False)))
        closed = closed.select(F.col(part).alias("closed_part"), "ending", "before")
        after = F.col("before") | (F.col(order) > F.col("ending"))
        kind = F.when(F.col("ending").isNull(), ROW).when(after, LATE).when(F.col(order) == F.col("ending"), MARKER).otherwise(ROW)
        placed = batch.join(closed, batch[part].eqNullSafe(closed["closed_part"]), "left").select(*batch.columns, kind.alias("kind"))
        still_open = cut(expected.join(known, part, "left_anti"))
        last = not still_open.isEmpty() and still_open.join(found, part, "left_anti").isEmpty()
        if last:
            placed = placed.unionByName(spark.range(1).select(F.lit(END).alias("kind")), allowMissingColumns=True)
        placed.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/batch={batch_id}")

    run_batches(rows, each, "ending", checkpoint)


def closed_rows(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`close_parts` wrote; a filter on ``kind`` opens the files of one kind only."""
    return spark.read.parquet(f"{path}/rows").drop("batch")
