"""Endless readers that number what they hand out, and go on with the epoch and step that were stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.positions import range_positions
from batchloom.sources.files import load_state
from batchloom.streaming.streams import run_batches


def follow_steps(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    order: Sequence[str],
    batch_size: int,
    steps_per_epoch: int,
    run: int = 0,
    checkpoint: str | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write the rows of a stream with ``position``, ``step`` and ``epoch``, from 0, which go on over micro-batches and runs.

    Rows of a micro-batch are numbered by ``order``, which tells all of them apart. A step is ``batch_size`` rows, also where a
    micro-batch ends inside it. ``score`` may add columns, such as a teacher's answers, in any order of rows: ``position`` keeps theirs.
    A micro-batch adds one row to the states, the number of rows handed out so far. A repeated one starts from the same state and writes
    the same rows. ``run`` counts the checkpoints: with a new one, pass a higher number, and numbering goes on after the runs before.
    """
    states = f"{path}/states"
    spark.createDataFrame([], "position bigint").write.mode("ignore").parquet(f"{states}/run=-1/batch=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema("position bigint, run int, batch int").parquet(states)
        earlier = (F.col("run") < run) | ((F.col("run") == run) & (F.col("batch") < batch_id))
        start = known.where(earlier).agg(F.max("position")).first()[0] or 0
        step = F.expr(f"position div {batch_size}")
        numbered = range_positions(batch, order, base=start, name="position").withColumn("step", step)
        numbered = numbered.withColumn("epoch", F.expr(f"step div {steps_per_epoch}"))
        folder = f"run={run}/batch={batch_id}"
        (score(numbered) if score else numbered).write.mode("overwrite").parquet(f"{path}/rows/{folder}")
        after = spark.read.parquet(f"{path}/rows/{folder}").agg((F.count(F.lit(1)) + start).alias("position"))
        after.write.mode("overwrite").parquet(f"{states}/{folder}")

    run_batches(rows, each, "steps", checkpoint)


def stepped_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were handed out; sorted by ``position`` they come in the reader's order."""
    return spark.read.parquet(f"{path}/rows").drop("run", "batch")


def rows_from_state(spark: SparkSession, path: str, states: str, name: str) -> DataFrame:
    """The rows to hand out again after a crash: from the newest stored step of ``name`` on, or all if none was stored.

    ``states`` was written by ``save_state`` with the columns ``epoch`` and ``step``. Steps only grow from file to file, so the filter
    on them skips the row groups that lie before.
    """
    stored = load_state(spark, states, "epoch bigint, step bigint").where(F.col("name") == name).first()
    rows = stepped_rows(spark, path)
    return rows if stored is None else rows.where(F.col("step") >= stored["step"])
