"""Helpers of the text operators: written tables, Arrow batches, words, groups of sorted rows, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.session import scratch

SLICE = 512  # rows whose texts or lists become Python objects at a time
WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts at exactly these six characters


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: a cut of the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches, cut to ``rows`` rows at most, so that few texts are Python objects at a time.

    At the end Arrow gives back what it keeps of the task: the worker lives on beside those of other tasks.
    """
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
    finally:
        pa.default_memory_pool().release_unused()


def text_ref(text: Column) -> Column:
    """128-bit hash of a text, null as empty: with the id it tells rows apart whose id is null or repeats."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def same_columns(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of the named column pairs."""
    result = None
    for a, b in pairs:
        test = left[a].eqNullSafe(right[b])
        result = test if result is None else result & test
    return result


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole runs of the sorted integer column ``key``."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held)
        keys = table[key].to_numpy()
        start = int(np.searchsorted(keys, keys[-1], "left"))
        if start:
            yield table.slice(0, start)
        held, count = [table.slice(start)], table.num_rows - start
    if count:
        yield pa.concat_tables(held)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the edges ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_edges = label[a] != label[b]
        a, b = a[open_edges], b[open_edges]
    return label


def _signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the integer edges ``(a, b)``: ``(node, root)`` for nodes that are not their root.

    Alternating large and small stars: every node links to the smallest neighbour, until all
    components are stars. Each round is written, so a lost executor costs one round at most.
    """
    pairs = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs"
    )
    before = _signature(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("low", "a").alias("low"))
        large = pairs.join(low, pairs["b"] == low["u"]).select("a", F.col("low").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        joined = large.join(least, large["a"] == least["u"])
        small = joined.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        pairs = store(small.select("e.a", "e.b").where("a <> b").distinct(), "pairs")
        after = _signature(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
