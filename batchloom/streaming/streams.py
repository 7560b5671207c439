"""Running streams to the end of their input, and the small pieces the stream operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.session import checkpoint_root, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch_folder(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """Stream of the parquet files that arrive in a folder, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_to_file(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> str:
    """Append the stream to a parquet table until its input is used up; the same checkpoint resumes it."""
    spark = stream.sparkSession
    path = path or scratch(spark, name)
    checkpoint = checkpoint or scratch(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return path


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None, mode: str = "append"
) -> None:
    """Hand every micro-batch to ``each`` until the input is used up."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def newest(spark: SparkSession, path: str, name: str) -> Column:
    """The highest number ``n`` of the folders ``name=n``, by the names of their files, as a folder may hold no rows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.load(path).agg(F.max(F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).cast("int"))).scalar()


class RocksDB:
    """Use the RocksDB state store for the streams started inside the block."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        checkpoint_root(self.spark)
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *problem):
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)
