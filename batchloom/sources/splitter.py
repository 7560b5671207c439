"""A user-defined file splitter as a Spark data source: one input partition per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from batchloom.sources.pairs import file_system


def line_splitter() -> Callable[[str], Iterator[tuple[int, str]]]:
    """The splitter for text files: number from 1 and text of each line that is not blank."""

    def strip_lines(path):
        import io

        number = 0
        store, name = file_system(path)
        with store.open_input_stream(name) as stream, io.TextIOWrapper(stream, encoding="utf-8", newline="\n") as lines:
            for line in lines:
                text = line.strip()
                if text:
                    number += 1
                    yield number, text

    return strip_lines


def register_splitter(
    spark: SparkSession, name: str, split: Callable[[str], Iterator[tuple]], schema: str = "idx bigint, record string"
) -> None:
    """Make ``spark.read.format(name).option("files", json_list).load()`` yield the splitter's rows per file, in Arrow batches."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(f"path string, {schema}"))

    class FilePartition(InputPartition):
        def __init__(self, path):
            self.path = path

    class SplitterReader(DataSourceReader):
        def __init__(self, options):
            import json

            self.files = json.loads(options["files"])

        def partitions(self):
            return [FilePartition(path) for path in self.files]

        def read(self, partition):
            from itertools import islice

            import pyarrow as pa

            records = iter(split(partition.path))
            while rows := list(islice(records, 10_000)):
                columns = [[partition.path] * len(rows), *zip(*rows)]
                arrays = [pa.array(c, kind.type) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    class SplitterSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"path string, {schema}"

        def reader(self, schema):
            return SplitterReader(self.options)

    spark.dataSource.register(SplitterSource)
