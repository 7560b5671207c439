"""What the two finders of repeated passages share: hashes of substrings, blocks of windows, and tables of spans.

A finder gives every window of a document an anchor that its content alone decides. Runs of windows with the same anchor are a
block ``(k, g, id, tid, pos, n)``: ``n`` windows from ``pos`` on, ``k`` a hash of what all windows of the anchor share, ``g`` a
hash of all that the block's windows cover. So equal windows have equal ``k``; blocks with equal ``k`` and ``g`` (128 bits) are equal.
Documents are told apart by ``id`` (the largest long if null, so these come last) and ``tid``, a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import store, text_bytes

NO_ID = (1 << 63) - 1
BLOCK = "k long, g long, id long, tid long, pos long, n long"
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4GB",
}


@contextmanager
def runtime_filters(spark: SparkSession):
    """Let Spark drop rows by a Bloom filter of the other side before it shuffles them, also where tables are not huge."""
    old = {k: spark.conf.get(k) for k in FILTERS}
    try:
        for k, v in FILTERS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of any substring of a sequence of 64-bit numbers, from running sums of powers."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def text_id(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >= 1 << 63 else value


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)``."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))


def runs_of(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows with the same anchor; -1 stands for no window."""
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, int)
    last = np.concatenate([edge[1:], [len(anchor)]]).astype(int) - 1 if len(edge) else edge
    real = anchor[edge] >= 0
    return edge[real], last[real]


def pieces(items: Iterable, window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Documents in chunks of about ``most`` elements: number and offset of each piece, and the pieces.

    Longer documents are cut into pieces that overlap so that each window lies in one piece, and starts in one only.
    """
    docs, offsets, held, size = [], [], [], 0
    for number, item in enumerate(items):
        for start in range(0, max(1, len(item) - window + 1), most):
            part = item if len(item) <= most else item[start : start + most + window - 1]
            docs.append(number)
            offsets.append(start)
            held.append(part)
            size += len(part)
            if size >= most:
                yield np.array(docs), np.array(offsets), held
                docs, offsets, held, size = [], [], [], 0
            if part is item:
                break
    if held:
        yield np.array(docs), np.array(offsets), held


def block_table(named: DataFrame, blocks_of: Callable, read: Callable, window: int, most: int, name: str) -> DataFrame:
    """All blocks of all documents. ``read`` makes a sequence of a text's bytes; ``blocks_of`` takes such sequences of ``most``
    elements together, and gives arrays ``k, g, number, pos, n``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = text_bytes(batch)
            ids, tids = batch.column("id").to_numpy(), np.array([text_id(x) for x in data], np.int64)
            for docs, offsets, held in pieces(map(read, data), window, most):
                k, g, number, pos, n = blocks_of(held)
                columns = [k.view(np.int64), g.view(np.int64), ids[docs[number]], tids[docs[number]], pos + offsets[number], n]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["k", "g", "id", "tid", "pos", "n"])

    return store(named.mapInArrow(rows, BLOCK), name)


def shared_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """The blocks whose ``k`` occurs twice or more: the only ones that can hold repeated windows."""
    spark = blocks.sparkSession
    keys = store(blocks.groupBy("k").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), f"{name}-keys")
    with runtime_filters(spark):
        return store(blocks.join(keys.where("times > 1").select("k"), "k", "left_semi"), f"{name}-shared")


def classes_of(shared: DataFrame, name: str) -> DataFrame:
    """Equal blocks as one: ``(k, g, n, first, copied)``; ``first`` is the earliest ``(id, tid, pos)``."""
    place = F.struct("id", "tid", "pos")
    found = shared.groupBy("k", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n"))
    return store(found.select("k", "g", "n", "first", (F.col("first") != F.col("last")).alias("copied")), f"{name}-classes")


def with_text(named: DataFrame, wanted: DataFrame, what: str, name: str) -> DataFrame:
    """``(id, tid, found, text)``: the documents of ``wanted`` with its rows' ``what`` columns gathered in ``found``.

    A document's rows are bounded by its length. Texts of other documents are filtered out before they are shuffled.
    """
    spark = named.sparkSession
    gathered = wanted.groupBy("id", "tid").agg(F.collect_list(F.struct(*what.split())).alias("found"), F.count(F.lit(1)).alias("times"))
    needed = store(gathered, f"{name}-wanted")
    with runtime_filters(spark):
        return store(named.join(needed.where("times > 0").select("id", "tid", "found"), "id"), f"{name}-texts")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.concatenate([ends[at[1:] - 1], ends[-1:]])


def spans_by_document(spans: DataFrame, name: str) -> DataFrame:
    """``(id, tid, spans)`` from ``(id, tid, start, end)``: sorted maximal spans."""
    gathered = spans.groupBy("id", "tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("spans"):
                flat = value.values
                s, e = merged(flat.field("start").to_numpy(), flat.field("end").to_numpy())
                out.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tid"), pa.array(out, kind)], names=["id", "tid", "spans"])

    return store(gathered.mapInArrow(rows, "id long, tid long, spans array<struct<start:long,end:long>>"), name)


def apply_spans(docs: DataFrame, spans: DataFrame, edit: Callable, schema: str, id_col: str, text_col: str, name: str) -> DataFrame:
    """``edit(text, starts, ends)`` for every row of ``docs``, as ``doc_id`` and the columns of ``schema``.

    Only the texts that have spans are shuffled to them; all rows are edited without spans where they are read, and the few
    results of the others replace these.
    """
    spark = docs.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    arrow = {"long": pa.int64(), "string": pa.string()}

    def edited(with_spans: bool) -> Callable:
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = text_bytes(batch)
                tids = [text_id(x) for x in data]
                out, place = [], []
                for k, x in enumerate(data):
                    if with_spans:
                        if tids[k] != batch.column("tid")[k].as_py():
                            continue
                        flat = batch.column("spans")[k].values
                        out.append(edit(x, flat.field("start").to_numpy(), flat.field("end").to_numpy()))
                    else:
                        out.append(edit(x, None, None))
                    place.append(k)
                columns = [batch.column("id" if with_spans else "doc_id").take(pa.array(place, pa.int64())), pa.array([tids[k] for k in place], pa.int64())]
                columns += [pa.array([o[i] for o in out], arrow[kinds[n]]) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=["id" if with_spans else "doc_id", "tid", *names])

        return rows

    touched = spans.withColumn("times", F.size("spans"))
    with runtime_filters(spark):
        texts = identified(docs, id_col, text_col).join(touched.where("times > 0").select("id", "tid", "spans"), "id")
        changed = store(texts.mapInArrow(edited(True), f"id long, tid long, {schema}").distinct(), name)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(edited(False), f"doc_id {kind}, tid long, {schema}")
    new = changed.select(F.col("id").alias("c_id"), F.col("tid").alias("c_tid"), *[F.col(n).alias(f"c_{n}") for n in names])
    joined = plain.join(new, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("c_id")) & (F.col("tid") == F.col("c_tid")), "left")
    return joined.select("doc_id", *[F.when(F.col("c_id").isNull(), F.col(n)).otherwise(F.col(f"c_{n}")).alias(n) for n in names])
