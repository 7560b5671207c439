"""Key tables in buckets: look-ups that move the keys to the table's buckets and never the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.lookups import HOT_ROWS, hot_keys


def save_bucketed(table: DataFrame, key: str, buckets: int, name: str, path: str) -> None:
    """Write ``table`` at ``path`` as the catalogue table ``name``, one sorted file per bucket of ``key``.

    The shuffle has the buckets of the table, so each task writes one file. Size ``buckets`` for the rows of one task.
    """
    dealt = table.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def bucketed_multi_get(rows: DataFrame, name: str, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The entry of the bucketed table ``name``, which has one row per key, for each row; nulls where it has none.

    Rows are shuffled to the buckets of the table; the table is read in place. Rows of the most frequent keys and of the null key
    stay where they are and meet the hot entries, 1000 at most, as a broadcast from the buckets that hold them.
    ``rows`` is read once to sample hot keys and once for each of these two ways.
    """
    table = rows.sparkSession.table(name)
    hot = hot_keys(rows, key, hot_rows)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(True)) if hot else F.col(key).isNull()
    entries = table.where(F.col(key).isin(hot) if hot else F.lit(False))
    here = rows.where(is_hot).join(F.broadcast(entries), key, "left")
    return rows.where(~is_hot).join(table.hint("merge"), key, "left").unionByName(here)


def bucketed_get(spark: SparkSession, name: str, key: str, keys: Sequence) -> DataFrame:
    """The entries of a short list of keys; only their buckets are opened."""
    return spark.table(name).where(F.col(key).isin(list(keys)))
