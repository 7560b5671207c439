"""Files of length-prefixed pairs as a data source: commit by an index of byte blocks, abort, reads by byte range."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "key binary, value binary"
CHUNK = 1 << 22  # bytes that a task reads at once


def file_system(uri: str):
    """File system and path of a qualified path, as Hadoop spells it; raises for a store that it can't open."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts and how long it is."""
    if column.null_count:
        raise ValueError("a pair has no key or no value")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def packed_pairs(batch: pa.RecordBatch) -> bytes:
    """The pairs of a batch: length of the key in 4 little-endian bytes, key, length of the value, value."""
    parts = [pieces(batch.column(c)) for c in ("key", "value")]
    sizes = 8 + parts[0][2] + parts[1][2]
    out = np.empty(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    for data, starts, lengths in parts:
        if lengths.max(initial=0) >= 1 << 32:
            raise ValueError("a pair has a key or a value of 4 GiB or more")
        out[at[:, None] + np.arange(4)] = lengths.astype("<u4").view(np.uint8).reshape(-1, 4)
        total = int(lengths.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(at + 4, lengths) + inside] = data[np.repeat(starts, lengths) + inside]
        at = at + 4 + lengths
    return out.tobytes()


def pairs_of(stream, name: str, start: int, end: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of one block of a file, read ``CHUNK`` bytes at a time; a pair that is cut is an error."""
    stream.seek(start)
    rest, done = b"", start
    while True:
        size = CHUNK if end is None else min(CHUNK, end - done - len(rest))
        more = stream.read(max(size, 0))
        data, at, keys, values = rest + more, 0, [], []
        while at + 4 <= len(data):
            middle = at + 4 + int.from_bytes(data[at : at + 4], "little")
            if middle + 4 > len(data):
                break
            after = middle + 4 + int.from_bytes(data[middle : middle + 4], "little")
            if after > len(data):
                break
            keys.append(data[at + 4 : middle])
            values.append(data[middle + 4 : after])
            at = after
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "value"])
        rest, done = data[at:], done + at
        if not more:
            break
    if rest or (end is not None and done < end):
        raise ValueError(f"{name} is cut inside the pair at byte {done}")


@dataclass
class Written(WriterCommitMessage):
    blocks: list = field(default_factory=list)  # [file name, start, end, pairs]


class Blocks(InputPartition):
    def __init__(self, blocks: list):
        self.blocks = blocks  # [file name, start, end or None]


class PairWriter(DataSourceArrowWriter):
    """Tasks write files of their own name; the index that the driver writes at the end makes them part of the folder."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.rows, self.block = options["folder"], int(options["rows"]), int(options["block"])
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = file_system(self.folder)
        store.create_dir(folder)
        message, out, names = Written(), None, []
        start = end = counted = rows = 0
        try:
            for batch in iterator:
                while batch.num_rows:
                    if out is None:
                        name = f"part-{context.partitionId():05d}-{len(names):04d}-{self.job}-{context.taskAttemptId()}.kv"
                        names.append(name)
                        out, start, end, counted, rows = store.open_output_stream(f"{folder}/{name}"), 0, 0, 0, 0
                    sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False) for c in batch.columns) + 8
                    fill = int(np.searchsorted(np.cumsum(sizes), self.block - (end - start))) + 1  # rows that complete the block
                    now = batch.slice(0, min(self.rows - rows, fill))
                    data = packed_pairs(now)
                    out.write(data)
                    end, counted, rows, batch = end + len(data), counted + now.num_rows, rows + now.num_rows, batch.slice(now.num_rows)
                    if rows == self.rows or end - start >= self.block:
                        message.blocks.append([names[-1], start, end, counted])
                        start, counted = end, 0
                    if rows == self.rows:
                        out.close()
                        out = None
            if out is not None:
                if counted:
                    message.blocks.append([names[-1], start, end, counted])
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            remove(store, folder, names)
            raise
        return message

    def commit(self, messages):
        store, folder = file_system(self.folder)
        store.create_dir(folder)
        before = indexes(store, folder) if self.overwrite else []
        replaced = sorted({b[0] for b in committed(store, before)})
        blocks = [b for m in messages if m is not None for b in m.blocks]
        draft = f"{folder}/.index-{self.job}.json"
        with store.open_output_stream(draft) as out:
            out.write("\n".join(json.dumps(b) for b in blocks).encode())
        store.move(draft, f"{folder}/_index-{self.job}.json")
        for path in before:
            store.delete_file(path)
        remove(store, folder, replaced)

    def abort(self, messages):
        store, folder = file_system(self.folder)
        remove(store, folder, sorted({b[0] for m in messages if m is not None for b in m.blocks}))


def remove(store, folder: str, names: list[str]) -> None:
    from pyarrow import fs

    for info in store.get_file_info([f"{folder}/{n}" for n in names]):
        if info.type == fs.FileType.File:
            store.delete_file(info.path)


def listed(store, folder: str) -> list:
    from pyarrow import fs

    infos = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((i for i in infos if i.type == fs.FileType.File), key=lambda i: i.path)


def indexes(store, folder: str) -> list[str]:
    return [i.path for i in listed(store, folder) if i.base_name.startswith("_index-")]


def committed(store, paths: list[str]) -> Iterator[list]:
    """The blocks of some indexes."""
    for path in paths:
        with store.open_input_stream(path) as lines:
            yield from (json.loads(line) for line in lines.read().decode().splitlines())


class PairReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.split = options["folder"], int(options["split"])

    def partitions(self):
        store, folder = file_system(self.folder)
        files = listed(store, folder)
        found = [i.path for i in files if i.base_name.startswith("_index-")]
        if not found:
            return [Blocks([[i.base_name, 0, None]]) for i in files if i.base_name[0] not in "._"] or [Blocks([])]
        parts, held, size = [], [], 0
        for name, start, end, _ in committed(store, found):
            held.append([name, start, end])
            size += end - start
            if size >= self.split:
                parts.append(Blocks(held))
                held, size = [], 0
        return [*parts, Blocks(held)] if held or not parts else parts

    def read(self, partition):
        store, folder = file_system(self.folder)
        for name, start, end in partition.blocks:
            with store.open_input_file(f"{folder}/{name}") as stream:
                yield from pairs_of(stream, f"{self.folder}/{name}", start, end)


class PairSource(DataSource):
    """Pairs of binary ``key`` and ``value``.

    A job's files count once the driver has written its index: the start, end and number of pairs of each block of a file. Tasks
    that fail remove what they wrote, an aborted job removes the files of its finished tasks, and what a lost executor leaves is in no index.
    Replacing a folder writes the new index first and then removes the old one with its files.
    """

    @classmethod
    def name(cls):
        return "length_prefixed_pairs"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PairReader(self.options)

    def writer(self, schema, overwrite):
        return PairWriter(self.options, overwrite)
