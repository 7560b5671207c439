"""Key-value files: Hadoop sequence files and length-prefixed pairs, both ways."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.sources.pairs import PairSource, qualified

BYTES_CLASS = "org.apache.hadoop.io.BytesWritable"


def pack_key(column: Column) -> Column:
    """Integer key as 8 little-endian bytes."""

    @F.pandas_udf("binary")
    def pack(keys: pd.Series) -> pd.Series:
        raw = keys.to_numpy("<i8").tobytes()
        return pd.Series([raw[i : i + 8] for i in range(0, len(raw), 8)])

    return pack(column)


def unpack_key(column: Column) -> Column:
    @F.pandas_udf("bigint")
    def unpack(keys: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(keys), "<i8"))

    return unpack(column)


def pack_vector(column: Column) -> Column:
    """Float vector as packed 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes())

    return pack(column)


def unpack_vector(column: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(v, "<f4"))

    return unpack(column)


def write_sequence_file(df: DataFrame, path: str) -> None:
    """Write binary columns ``key`` and ``value`` as a sequence file of BytesWritable pairs."""
    df.select("key", "value").rdd.map(lambda r: (bytearray(r[0]), bytearray(r[1]))).saveAsSequenceFile(path)


def read_sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """Sequence file of BytesWritable pairs as binary columns ``key`` and ``value``."""
    pairs = spark.sparkContext.sequenceFile(path, BYTES_CLASS, BYTES_CLASS)
    return spark.createDataFrame(pairs.map(lambda p: (bytes(p[0]), bytes(p[1]))), "key binary, value binary")


def write_raw_kv(df: DataFrame, path: str, rows_per_file: int = 100_000, block_bytes: int = 1 << 27, mode: str = "append") -> None:
    """Write length-prefixed pairs, several files per task; a job that fails leaves none, see :class:`PairSource`.

    ``path`` is a folder of any store that the executors reach, with or without its scheme. Null keys or values fail the job.
    """
    spark = df.sparkSession
    spark.dataSource.register(PairSource)
    pairs = df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    options = {"folder": qualified(spark, path), "rows": rows_per_file, "block": block_bytes}
    pairs.write.format(PairSource.name()).mode(mode).options(**options).save()


def read_raw_kv(spark: SparkSession, path: str, split_bytes: int = 1 << 25) -> DataFrame:
    """Length-prefixed pairs as binary columns, from all committed files of the folder, or all its files if none has an index.

    Blocks of the index are dealt to tasks of about ``split_bytes``. A file that ends inside a pair fails the job with its name.
    """
    spark.dataSource.register(PairSource)
    return spark.read.format(PairSource.name()).option("folder", qualified(spark, path)).option("split", split_bytes).load()
