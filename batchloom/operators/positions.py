"""Dense positions (0, 1, 2, ...) without a window that holds all rows, or a hot group, in one task.

Every variant cuts the rows into blocks of bounded size that follow the order, counts the blocks,
adds up the counts before each block, and numbers the rows inside their block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.carry import over_earlier
from batchloom.session import cut, scratch

ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality on equally named columns."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def _number_blocks(df: DataFrame, group: Sequence[str], order: Sequence, name: str, base: int) -> DataFrame:
    """Positions from rows that already carry ``_block``."""
    keys = [*group, "_block"]
    # one row per block; their sums are carried level by level, so sparse ids and hot groups meet in no single task
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    before = over_earlier(counts, group).select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], F.coalesce("_carry", F.lit(0)).alias("_before")
    )
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(before[f"_b_{k}"]) for k in keys])
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.join(before, match, "left")  # each row has its match; an outer join never broadcasts the rows
        .withColumn(name, (inside + F.col("_before") + F.lit(base - 1)).cast("bigint"))
        .drop("_before", "_block", *[f"_b_{k}" for k in keys])
    )


def line_positions(lines: DataFrame, name: str, base: int = 0) -> DataFrame:
    """Positions per file of the rows of text files, from ``file_path``, ``_block`` (where the split starts) and ``_line``.

    ``_line`` is an increasing id that was given after all filters. A task reads a split from start to end, so the place in it is the id
    less the first one of the split, and no line is shuffled or sorted. The splits are written first, so Spark knows their
    size: it broadcasts them while they are small, past that they are joined.
    """
    spark, path = lines.sparkSession, scratch(lines.sparkSession, "splits")
    counts = lines.groupBy("file_path", "_block").agg(F.count(F.lit(1)).alias("_total"), F.min("_line").alias("_first"))
    firsts = cut(counts)
    before = over_earlier(firsts.select("file_path", "_block", "_total"), ["file_path"]).select(
        F.col("file_path").alias("_b_file"), F.col("_block").alias("_b_block"), F.coalesce("_carry", F.lit(0)).alias("_before")
    )
    match = (F.col("file_path") == F.col("_b_file")) & (F.col("_block") == F.col("_b_block"))
    splits = firsts.join(before, match).select("_b_file", "_b_block", (F.col("_before") - F.col("_first")).alias("_shift"))
    splits.write.option("compression", "zstd").parquet(path)
    return (
        lines.join(spark.read.schema(splits.schema).parquet(path), match)
        .withColumn(name, (F.col("_line") + F.col("_shift") + F.lit(base)).cast("bigint"))
        .drop("_line", "_shift", "_block", "_b_file", "_b_block")
    )


def id_positions(
    df: DataFrame, id_col: str, group: Sequence[str] = (), name: str = "pos", base: int = 0, width: int = 1 << 12
) -> DataFrame:
    """Positions in the order of a unique integer column, per ``group``; a block holds at most ``width`` ids.

    A task sorts whole blocks, so ``width`` is small enough for rows with texts.
    """
    blocks = df.withColumn("_block", F.expr(f"`{id_col}` div {width}"))
    return _number_blocks(blocks, group, [id_col], name, base)


def hash_positions(
    df: DataFrame, key: Column, ties: Sequence[str], name: str = "pos", base: int = 0, digits: int = 4
) -> DataFrame:
    """Positions in md5 order of ``key``; the hash prefix spreads unique keys evenly over the blocks."""
    hashed = df.withColumn("_hash", F.md5(key)).withColumn("_block", F.substring("_hash", 1, digits))
    return _number_blocks(hashed, (), ["_hash", *ties], name, base).drop("_hash")


def range_positions(df: DataFrame, order: Sequence, name: str = "pos", base: int = 0) -> DataFrame:
    """Positions for any sort order, also composite or text keys.

    The range shuffle samples its bounds per job, so its outcome is checkpointed before it is read
    twice. There is one offset per shuffle partition, which bounds the broadcast.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(ROW_BITS))
    )
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(before), "_block")
        .withColumn(name, (F.col("_seq") + F.col("_before") + F.lit(base)).cast("bigint"))
        .drop("_block", "_seq", "_before")
    )


def grouped_positions(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "pos", base: int = 0) -> DataFrame:
    """Positions inside each group for any sort order; a hot group spreads over many range partitions."""
    placed = range_positions(df, [*group, *order], name="_global")
    starts = placed.groupBy(*group).agg(F.min("_global").alias("_start")).select(
        *[F.col(g).alias(f"_b_{g}") for g in group], "_start"
    )
    match = reduce(lambda a, b: a & b, [placed[g].eqNullSafe(starts[f"_b_{g}"]) for g in group])
    # one row per group; AQE broadcasts it when small and splits hot groups otherwise
    return (
        placed.join(starts, match)
        .withColumn(name, (F.col("_global") - F.col("_start") + F.lit(base)).cast("bigint"))
        .drop("_global", "_start", *[f"_b_{g}" for g in group])
    )
