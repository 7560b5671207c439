"""Best-fit packing of token sequences: local best fit, nearly full bins out, underfull bins merged up a tree."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import slices, store

CAPACITY = 1024
END = 2
CACHED = 400_000  # units whose ids a Python worker remembers, for one task
TASK_BINS = 100_000  # underfull bins that meet in one task
PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


class Odd(Exception):
    """A text with white space that doesn't split into independent units."""


class Units(dict):
    """Ids, as little-endian bytes, of a space and the key. A text that is cut before single spaces has the ids of its units."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise Odd
        ids = np.array(self.encode(" " + unit), "<u4").tobytes()
        if len(self) < CACHED:
            self[unit] = ids
        return ids


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as its tokenizer file gives them.

    The file's ranks are given to a faster encoder of the same vocabulary; texts that name a special token go through the
    tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.units = Units(self.encode)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Odd
            return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.units.__getitem__, rest))
        except Odd:
            return np.array(self.encode(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, ranks: str) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(public_tokenizers.path(vocabulary), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document: whole capacities, after a first one that may be shorter."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def encoded(batches: Iterable[pa.RecordBatch], model: ByteBpe, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of the rows ``(doc_id, text)``."""
    end = np.array([END], "<u4").tobytes()
    try:
        for batch in slices(batches):
            own: list[list] = [[] for _ in range(6)]
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = (model.ids(text) if text else b"") + end
                for number, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(own, (at, number, start, length, crc32(part), part)):
                        column.append(value)
            columns = [batch.column("doc_id").take(pa.array(own[0], pa.int64())), pa.array(own[1], pa.int32())]
            columns += [pa.array(own[k], pa.int64()) for k in (2, 3, 4)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in own[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    finally:
        model.units.clear()  # the worker lives on, and later tasks of any kind need the memory


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    keep_ids: bool = False,
) -> DataFrame:
    """The tokenised pieces of every row, with a CRC-32 of their ids, and the ids themselves if asked for."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECE.format(kind=dict(chosen.dtypes)["doc_id"]) + (", ids array<int>" if keep_ids else "")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, byte_bpe(vocabulary, ranks), capacity, keep_ids)

    return chosen.mapInArrow(rows, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit of the items, largest first: each goes to the fullest bin that still holds it. Bins as lists of items."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by space left
    mask = 0  # a bit for each space that some bin has left
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = mask >> size
        if fits:
            space = (fits & -fits).bit_length() - 1 + size
            own = open_bins[space].pop()
            if not open_bins[space]:
                mask ^= 1 << space
            bins[own].append(item)
        else:
            space, own = capacity, len(bins)
            bins.append([item])
        if space > size:
            open_bins[space - size].append(own)
            mask |= 1 << (space - size)
    return bins


def merge(items: DataFrame, capacity: int, nearly: int, turn: int, last: bool) -> DataFrame:
    """Best fit of the rows ``(fill, items)`` of each partition into bins; ``sequence_id`` is set on those that are done."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        sizes = table["fill"].to_numpy()
        bins = best_fit(sizes, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
        ends = np.cumsum([len(b) for b in bins])
        fills = np.add.reduceat(sizes[order], np.concatenate([[0], ends[:-1]]))
        taken = table["items"].combine_chunks().take(pa.array(order))
        counts = np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))
        flat, offsets = taken.flatten(), np.concatenate([[0], counts[ends - 1]]).astype(np.int32)
        base = (turn << 56) + (TaskContext.get().partitionId() << 32)
        done = (fills >= nearly) | last
        ids = pa.array(base + np.arange(len(bins)), pa.int64(), mask=~done)
        first = np.repeat(offsets[:-1], np.diff(offsets))  # the first item of each item's bin
        lengths = flat.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        moved = [pa.array(before - before[first]) if f.name == "offset" else flat.field(f.name) for f in flat.type]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(moved, fields=list(flat.type)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(fills.astype(np.int64)), lists], names=["sequence_id", "fill", "items"])

    kind = dict(items.dtypes)["items"]
    return items.select("fill", "items").mapInArrow(rows, f"sequence_id long, fill long, items {kind}")


def pack(found: DataFrame, capacity: int = CAPACITY, nearly_full: float = 0.995, fan_in: int = 8) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Each partition packs its own rows; bins that are nearly full are done, the others are items of the next round, in which
    ``fan_in`` partitions meet in one, but never more than TASK_BINS bins. It ends with a round of a single task, or when
    merging hardly saves bins any more. Each round is written once, so what a lost executor repeats is the same.
    """
    zero = F.lit(0).cast("long").alias("offset")
    whole = found.where(F.col("length") == capacity)
    rest = found.where(F.col("length") < capacity).select(
        F.col("length").alias("fill"), F.array(F.struct(*found.columns, zero)).alias("items")
    )
    result = whole.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", zero)
    count = rest.count()
    tasks, turn, last = max(1, -(-count // TASK_BINS)), 1, False
    while count:
        last = last or tasks == 1
        bins = store(merge(rest.repartition(tasks, F.xxhash64("items")), capacity, int(nearly_full * capacity), turn, last), "bins")
        placed = bins.where("sequence_id is not null").select("sequence_id", F.explode("items").alias("item"))
        result = result.unionByName(placed.select("item.*", "sequence_id"))
        rest, before = bins.where("sequence_id is null"), count
        count = rest.count()
        last = count > 0.99 * before
        tasks, turn = max(1, -(-tasks // fan_in), -(-count // TASK_BINS)), turn + 1
    return result


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, **files) -> DataFrame:
    """A row per piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null and empty texts are the end token alone. Repeated rows are packed once each. An empty table gives no rows.
    """
    return pack(store(pieces(docs, id_col, text_col, capacity, keep_ids=keep_ids, **files), "pieces"), capacity)
