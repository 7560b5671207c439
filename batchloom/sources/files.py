"""Parquet chunk files, feed declarations, done files, state tables and versioned checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED_TYPES = {"int64": T.LongType(), "float32": T.FloatType()}


def write_chunks(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Chunk files with at most ``rows_per_file`` rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_chunk_files(spark: SparkSession, path: str, trainers: int, trainer_id: int) -> DataFrame:
    """Rows of the sorted chunk files number ``trainer_id``, ``trainer_id + trainers``, ...

    Only the own files are opened; the list of names is the one Spark plans a scan with.
    """
    files = sorted(spark.read.parquet(path).inputFiles())
    return spark.read.option("basePath", path).parquet(*files[trainer_id::trainers])


def synthetic_samples(ids: DataFrame, id_col: str, slots: dict[str, Sequence[int]]) -> DataFrame:
    """One flat tensor per slot and id, with values in [0, 1) that depend on the id and the place only."""

    def tensor(shape: Sequence[int], salt: int) -> Column:
        size = 1
        for length in shape:
            size *= length
        places = F.sequence(F.lit(0), F.lit(size - 1))
        return F.transform(places, lambda i: F.pmod(F.col(id_col) * 31 + i * 17 + salt, F.lit(101)) / F.lit(101.0))

    return ids.select(id_col, *[tensor(shape, n).alias(name) for n, (name, shape) in enumerate(slots.items())])


def declare_feed_schema(feeds: Sequence[tuple[str, Sequence[int], str]]) -> T.StructType:
    """Schema of the model inputs from ``(name, shape, int64 | float32)``; the shape goes to the metadata."""
    return T.StructType(
        [T.StructField(n, T.ArrayType(FEED_TYPES[t]), False, {"shape": list(shape)}) for n, shape, t in feeds]
    )


def check_feed_schema(df: DataFrame, feeds: T.StructType) -> None:
    """Raise when a declared feed is absent or has another element type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    for field in feeds.fields:
        actual = found.get(field.name)
        if not isinstance(actual, T.ArrayType) or actual.elementType != field.dataType.elementType:
            raise ValueError(f"feed {field.name} needs {field.dataType.simpleString()}, found {actual}")


def feed_violations(df: DataFrame, feeds: T.StructType) -> DataFrame:
    """Rows and rows of the wrong size, per declared feed, in one pass."""
    sizes = []
    for field in feeds.fields:
        size = 1
        for length in field.metadata["shape"]:
            size *= length
        wrong = F.count_if(F.coalesce(F.size(field.name), F.lit(-1)) != size)
        sizes.append(F.struct(F.lit(field.name).alias("feed"), F.count(F.lit(1)).alias("n_rows"), wrong.alias("bad_rows")))
    return df.agg(F.array(*sizes).alias("f")).select(F.inline("f"))


def write_donefile(spark: SparkSession, donefile: str, stamp: int, data_path: str) -> None:
    """Append one line ``{id, key, input}`` after the data has been committed."""
    line = spark.range(1).select(
        F.lit(str(stamp)).alias("id"), F.lit(str(stamp)).alias("key"), F.lit(data_path).alias("input")
    )
    line.write.mode("append").json(donefile)


def save_state(states: DataFrame, path: str) -> None:
    """Append versioned states as JSON text; nothing that was written changes."""
    body = F.to_json(F.struct(*[c for c in states.columns if c not in ("name", "version")]))
    states.select("name", "version", body.alias("state")).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The newest state per name."""
    newest = spark.read.parquet(path).groupBy("name").agg(
        F.max("version").alias("version"), F.max_by("state", "version").alias("state")
    )
    return newest.withColumn("s", F.from_json("state", schema)).select("name", "version", "s.*")


def save_version(df: DataFrame, path: str, version: int) -> None:
    """One immutable folder per version; the committer adds the success marker last."""
    df.write.parquet(f"{path}/version={version}")


def valid_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that carry the success marker."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(hadoop_path):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def load_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    version = valid_versions(spark, path)[-1]
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version).cast("bigint"))


def write_metric_log(passes: DataFrame, path: str, trainers: int, batch_size: int) -> None:
    """Result of a run from one row per pass: last accuracies, history, top speed of all trainers, batch size."""
    history = F.collect_list(F.struct("epoch", F.col("mean_acc1").alias("acc1"), F.col("mean_acc5").alias("acc5")))
    passes.agg(
        F.max_by("mean_acc1", "epoch").alias("acc1"),
        F.max_by("mean_acc5", "epoch").alias("acc5"),
        history.alias("result_log"),
        (F.max("speed") * trainers).alias("max_speed"),
        F.lit(batch_size).alias("batch_size"),
    ).write.json(path)
