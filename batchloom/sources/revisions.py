"""A change log that is read as a stream by revision: what lies before the start, or before a checkpoint, is never opened."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.sources.pairs import file_system, qualified

FOLDER = re.compile(r"revisions=(-?\d+)\.\.(-?\d+)$")


def append_revisions(changes: DataFrame, log: str, revision: str) -> None:
    """Append changes to a log, in a folder that is named by their first and last revision; nothing is written for no rows.

    Revisions must grow from one append to the next. Files inside follow the revisions too.
    """
    first, last = changes.agg(F.min(revision), F.max(revision)).first()
    if first is not None:
        changes.repartitionByRange(revision).sortWithinPartitions(revision).write.parquet(f"{log}/revisions={first}..{last}")


def folders(log: str) -> list[tuple[int, int, str]]:
    """First revision, last revision and path of every append that was committed, by their names alone."""
    from pyarrow import fs

    store, root = file_system(log)
    found = []
    for entry in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        match = FOLDER.search(entry.path)
        if match and store.get_file_info(f"{entry.path}/_SUCCESS").type != fs.FileType.NotFound:
            found.append((int(match[1]), int(match[2]), entry.path))
    return sorted(found)


def register_revisions(spark: SparkSession, name: str = "revisions") -> None:
    """Make ``spark.readStream.format(name)`` follow a log by revision; the offset is the next revision to read.

    Options: ``log``, ``revision`` (the column) and ``start`` (the first revision to read, 0 if it is left out). A checkpoint of an earlier run goes before
    ``start``. Each file is a task, read in Arrow batches.
    """
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
    from pyspark.sql.pandas.types import to_arrow_schema

    class LogFile(InputPartition):
        def __init__(self, path, first, end):
            self.path, self.first, self.end = path, first, end

    class RevisionReader(DataSourceStreamReader):
        def __init__(self, schema, options):
            self.log, self.revision = options["log"], options["revision"]
            self.start = int(options.get("start", 0))
            self.kinds = to_arrow_schema(schema)

        def initialOffset(self):
            return {"next": self.start}

        def latestOffset(self):
            return {"next": max([self.start, *[last + 1 for _, last, _ in folders(self.log)]])}

        def partitions(self, start, end):
            from pyarrow import fs

            store, _ = file_system(self.log)
            found = []
            for first, last, path in folders(self.log):
                if first < end["next"] and last >= start["next"]:
                    files = store.get_file_info(fs.FileSelector(path))
                    found += [LogFile(f.path, start["next"], end["next"]) for f in files if f.path.endswith(".parquet")]
            return found or [LogFile(None, 0, 0)]

        def read(self, partition):
            import pyarrow.compute as pc
            import pyarrow.parquet as pq

            if partition.path is None:
                return
            store, _ = file_system(self.log)
            with store.open_input_file(partition.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=self.kinds.names):
                    at = batch.column(self.revision)
                    wanted = pc.and_(pc.greater_equal(at, partition.first), pc.less(at, partition.end))
                    yield batch.filter(wanted).select(self.kinds.names).cast(self.kinds)

    class RevisionSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            raise ValueError("give the schema of the log: readStream.schema(...)")

        def streamReader(self, schema):
            return RevisionReader(schema, self.options)

    spark.dataSource.register(RevisionSource)


def read_revisions(spark: SparkSession, log: str, schema: str, revision: str, start: int = 0) -> DataFrame:
    """Stream of a log's changes from revision ``start`` on, or from where the stream's checkpoint stands."""
    register_revisions(spark)
    reader = spark.readStream.format("revisions").schema(schema).option("log", qualified(spark, log))
    return reader.option("revision", revision).option("start", str(start)).load()
