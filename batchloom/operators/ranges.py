"""Record ranges with inclusive bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.carry import id_block, with_running
from batchloom.session import cut


def merge_ranges(ranges: DataFrame, file: str, begin: str, end: str, width: int = 1 << 18) -> DataFrame:
    """Smallest set of ranges per file: ranges that overlap or touch become one."""
    # equal ranges go first: both windows below then see one order
    rows, order, block = cut(ranges.select(file, begin, end).distinct()), [begin, end], id_block(begin, width)
    seen = with_running(rows, F.col(end), "_reach", [file], order, block, "max", include_current=False)
    starts = F.when(F.col("_reach").isNull() | (F.col(begin) > F.col("_reach") + 1), 1).otherwise(0)
    islands = with_running(seen.withColumn("_start", starts), F.col("_start"), "_island", [file], order, block)
    return islands.groupBy(file, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("_island")


def range_text(idx: Column, path: Column, begin: Column, end: Column) -> Column:
    """Text of a file's record range, every record number spelled out."""
    numbers = F.transform(F.sequence(begin, end), lambda n: F.concat(F.lit("(record_no:"), n.cast("string"), F.lit(")")))
    head = F.concat(F.lit("idx_in_list:"), idx.cast("string"), F.lit(", file_path:"), path)
    return F.concat(head, F.lit(" record:["), F.array_join(numbers, ""), F.lit("]"))
