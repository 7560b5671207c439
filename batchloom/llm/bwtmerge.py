"""Suffix-array deduplication of long repeats by merging Burrows-Wheeler transforms.

Documents are cut into blocks of windows by content-defined anchors; blocks without a partner can hold no repeat. The others are
dealt by their anchor, so equal windows meet in a task. A task sorts shards of them, then merges the shards' transforms by
refining their interleave, one symbol of the suffixes in each turn; the refined groups are the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import shuffle_partitions, store, text_bytes
from batchloom.llm.repeats import (
    BASES,
    Sums,
    apply_spans,
    block_table,
    classes_of,
    identified,
    mix,
    runs_of,
    shared_blocks,
    spans_by_document,
    text_id,
    with_text,
)

LENGTH = 400
SYMBOL = 50  # bytes; suffixes are compared by symbols of so many, LENGTH of them make DEPTH symbols
DEPTH = LENGTH // SYMBOL
ANCHOR = 128  # bytes of an anchor
CHUNK = 1 << 20  # bytes that are looked at together
SHARD = 1 << 17  # bytes that are sorted at once; merging makes one transform of all shards of a task
TASK_BYTES = 1 << 21  # of blocks that meet in a task
CROWD = 1000  # unlike blocks of an anchor, beyond which they are cut into parts, dealt by more of their content
STEP = 35  # distances of an anchor from the start of its windows that are one part: 8 parts at most
BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def byte_blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Blocks of LENGTH-byte windows; a window's anchor is the ANCHOR bytes in it with the smallest hash, the leftmost of equal ones."""
    texts_long = [(i, x) for i, x in enumerate(texts) if len(x) >= LENGTH]
    none = np.zeros(0, np.int64)
    if not texts_long:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sizes = np.array([len(x) for _, x in texts_long])
    starts = np.cumsum(sizes) - sizes
    names = BYTE_NAMES[np.frombuffer(b"".join(x for _, x in texts_long), np.uint8)]
    one = Sums(names, BASES[0])
    at = np.arange(len(names) - ANCHOR + 1)
    hashes = one.of(at, at + ANCHOR)
    ranked = ((hashes >> np.uint64(29)) << np.uint64(28)).astype(np.int64) | at
    best = sliding_min(ranked, LENGTH - ANCHOR + 1) & ((1 << 28) - 1)
    valid = np.zeros(len(names) + 1, np.int64)
    valid[starts] += 1
    valid[starts + sizes - LENGTH + 1] -= 1
    inside = np.cumsum(valid)[: len(best)] > 0
    first, last = runs_of(np.where(inside, best, -1))
    # the last window of a text and the first one of the next may have the same anchor only by crossing it, which no window does
    anchor = best[first]
    two = Sums(names, BASES[1])
    g = mix(two.of(first, last + LENGTH) + (anchor - first).astype(np.uint64))
    doc = np.searchsorted(starts, first, "right") - 1
    return hashes[anchor], g, np.array([i for i, _ in texts_long])[doc], first - starts[doc], last - first + 1


@dataclass
class Transform:
    """Sorted suffixes of a shard: ends of chains first. ``before`` is the symbol before each, 0 at the start of its chain."""

    before: np.ndarray
    row: np.ndarray  # place in the texts, -1 for ends
    ends: int


@dataclass
class Chains:
    """Texts in symbols. A suffix at a byte goes on SYMBOL bytes further, so each text is SYMBOL chains of symbols.

    By place: ``code``, the number of the symbol that begins there, 0 if less than SYMBOL bytes are left, and the bytes up to
    the start and the end of the text. All shards number symbols alike.
    """

    code: np.ndarray
    local: np.ndarray
    room: np.ndarray

    def part(self, start: int, end: int) -> Chains:
        return Chains(self.code[start:end], self.local[start:end], self.room[start:end])


def chains(texts: list[bytes]) -> Chains:
    sizes = np.array([len(x) for x in texts])
    names = BYTE_NAMES[np.frombuffer(b"".join(texts), np.uint8)]
    local = np.arange(len(names)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    room = np.repeat(sizes, sizes) - local
    at = np.flatnonzero(room >= SYMBOL)
    code = np.zeros(len(names), np.int64)
    code[at] = pd.factorize(Sums(names, BASES[0]).of(at, at + SYMBOL))[0] + 1  # any order of the symbols will do, if it is one
    return Chains(code, local, room)


def ranked(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, from 1, of less than 2**bits numbers below 2**(63-bits); their places in order, and the rank of each place."""
    keys = (values << bits) | np.arange(len(values))
    keys.sort()
    place = keys & ((1 << bits) - 1)
    keys >>= bits
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    ordered = np.cumsum(new)
    ranks = np.empty(len(keys), np.int64)
    ranks[place] = ordered
    return ranks, place, ordered


def transform(shard: Chains, base: int) -> tuple[Transform, np.ndarray]:
    """The transform of a shard, by ranks of 1, 2, 4 and so on up to DEPTH symbols, and the group of each row at that depth.

    A shard has less than 2**21 bytes, so that two ranks and a place fit in 63 bits.
    """
    at = np.flatnonzero(shard.code)
    bits = len(shard.code).bit_length()
    room = shard.room[at]
    rank = np.zeros(len(shard.code), np.int64)
    rank[at], place, group = ranked(shard.code[at], bits)
    known, depth = {1: rank}, 1
    while depth < DEPTH:
        step = max(d for d in known if d <= DEPTH - depth)
        further = np.zeros(len(at), np.int64)  # rank of the suffix ``depth`` symbols further, 0 beyond the end
        goes = room >= (depth + 1) * SYMBOL
        further[goes] = known[step][at[goes] + depth * SYMBOL]
        new = np.zeros(len(shard.code), np.int64)
        new[at], place, group = ranked((known[depth][at] << bits) | further, bits)
        depth += step
        known[depth] = new
    order = at[place]
    before = np.where(shard.local[order] >= SYMBOL, shard.code[np.maximum(order - SYMBOL, 0)], 0)
    last = at[room < 2 * SYMBOL]  # the last symbol of each chain stands before its end
    whole = Transform(np.concatenate([shard.code[last], before]), np.concatenate([np.full(len(last), -1), order + base]), len(last))
    return whole, np.concatenate([np.zeros(len(last), np.int64), group])


def merge(shards: list[Transform]) -> tuple[Transform, np.ndarray]:
    """Merge transforms and group their rows by the first DEPTH symbols, without sorting suffixes again.

    ``source`` says of each merged row whose it is. In each turn every row sends its source to the place of the row before it in
    the text: those with a smaller symbol before them first, equal symbols in the present order. After ``t`` turns rows are
    in the order of their first ``t`` symbols, and a row starts a new group where its first ``t`` symbols are not those of the row above.
    """
    # stable sorts of such small numbers are linear
    numbers = np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint16)
    before = np.concatenate([s.before for s in shards]).astype(np.int32)
    ends = np.repeat(numbers, [s.ends for s in shards])
    source = np.repeat(numbers, [len(s.before) for s in shards])
    group = np.zeros(len(before), np.int32)
    merged, new = np.empty(len(before), np.int32), np.ones(len(before) - len(ends), bool)
    for _ in range(DEPTH):
        merged[np.argsort(source, kind="stable")] = before
        keys = np.flatnonzero(merged)
        keys |= merged[keys].astype(np.int64) << 32
        keys.sort()
        order = keys.astype(np.uint32)  # the lower half
        keys >>= 32
        above = group[order]
        new[1:] = (keys[1:] != keys[:-1]) | (above[1:] != above[:-1])
        source[len(ends) :] = source[order]
        source[: len(ends)] = ends
        group[: len(ends)] = 0
        np.cumsum(new, out=group[len(ends) :])
    places = np.argsort(source, kind="stable")
    whole = Transform(np.empty_like(before), np.empty(len(before), np.int64), len(ends))
    whole.before[places], whole.row[places] = before, np.concatenate([s.row for s in shards])
    return whole, group


def repeated_rows(texts: list[bytes], weights: np.ndarray, shard: int = 0) -> np.ndarray:
    """Places in the joined texts whose next LENGTH bytes occur again. ``weights``, by place: how often the window that begins there counts."""
    symbols = chains(texts)
    ends = np.cumsum([len(x) for x in texts])
    cuts = ends[np.append(np.diff(ends // (shard or SHARD)) > 0, True)]
    shards = [transform(symbols.part(a, b), a) for a, b in zip([0, *cuts[:-1]], cuts)]
    whole, group = shards[0] if len(shards) == 1 else merge([s for s, _ in shards])
    real = whole.row >= 0
    rows, group = whole.row[real], group[real]
    counts = np.bincount(group, weights[rows])
    return np.sort(rows[(counts[group] > 1) & (weights[rows] > 0)])


def merged_repeats(blocks: DataFrame, key: str = "k") -> DataFrame:
    """``(k, g, start, end)`` of blocks ``(k, g, weight, n, skip, bytes)``: bytes in windows that occur twice or more among blocks of equal
    ``key``. ``skip`` is where the bytes begin in the block ``(k, g)``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        texts = table["bytes"].to_pylist()
        n, weight = table["n"].to_numpy(), table["weight"].to_numpy()
        sizes = np.array([len(x) for x in texts])
        starts = np.cumsum(sizes) - sizes
        local = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        weights = np.where(local < np.repeat(n, sizes), np.repeat(weight, sizes), 0)
        found = repeated_rows(texts, weights)
        if not len(found):
            return
        block = np.searchsorted(starts, found, "right") - 1
        new = np.concatenate([[True], (found[1:] != found[:-1] + 1) | (block[1:] != block[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(found)]]) - 1
        owner = block[first]
        place = table["skip"].to_numpy()[owner] - starts[owner]
        columns = [table["k"].to_numpy()[owner], table["g"].to_numpy()[owner], found[first] + place, found[last] + place + LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "g", "start", "end"])

    volume = blocks.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = max(shuffle_partitions(blocks.sparkSession), -(-volume // TASK_BYTES))
    return blocks.repartition(parts, key).sortWithinPartitions(key, "k", "g", "skip").mapInArrow(rows, "k long, g long, start long, end long")


def block_parts(blocks: DataFrame) -> DataFrame:
    """``(part, k, g, weight, n, skip, bytes)``: the windows of each block by how far into them the anchor begins, STEP distances together.

    Windows of a part share the bytes that the window of the least distance and that of the greatest have in common, 366 or more of
    LENGTH. ``part`` is a hash of these, so equal windows meet in it, and few unlike blocks do.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                names = BYTE_NAMES[np.frombuffer(r["bytes"], np.uint8)]
                sums = Sums(names, BASES[0])
                # all windows hold the anchor; the last one begins before it and takes the leftmost of equal ones
                at = np.arange(r["n"] - 1, LENGTH - ANCHOR + 1)
                anchor = int(at[np.flatnonzero(sums.of(at, at + ANCHOR).view(np.int64) == r["k"])[0]])
                for low in range((anchor - r["n"] + 1) // STEP * STEP, anchor + 1, STEP):
                    high = min(low + STEP, LENGTH - ANCHOR + 1) - 1
                    first, last = max(anchor - high, 0), min(anchor - low, r["n"] - 1)
                    core = sums.of(np.array([anchor - low]), np.array([anchor - high + LENGTH]))
                    part = int(mix(core + np.uint64(low)).view(np.int64)[0])
                    out.append((part, r["k"], r["g"], r["weight"], last - first + 1, first, r["bytes"][first : last + LENGTH]))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "k", "g", "weight", "n", "skip", "bytes"])

    return blocks.mapInArrow(rows, "part long, k long, g long, weight long, n long, skip long, bytes binary")


def crowd_repeats(blocks: DataFrame) -> DataFrame:
    """The same for anchors with very many unlike blocks: by parts of the blocks. Parts that many still share go window by window."""
    parts = store(block_parts(blocks), "byte-parts")
    often = parts.groupBy(F.col("part").alias("of_part")).agg(F.sum("weight").alias("times"), F.count(F.lit(1)).alias("kinds")).where("times > 1")
    met = store(parts.join(often, F.col("part") == F.col("of_part")).drop("of_part", "times"), "byte-parts-met")
    return merged_repeats(met.where(F.col("kinds") <= CROWD), "part").unionByName(window_repeats(met.where(F.col("kinds") > CROWD)))


def window_repeats(blocks: DataFrame) -> DataFrame:
    """The same, each window for itself, by a 128-bit hash of its bytes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names = BYTE_NAMES[np.frombuffer(r["bytes"], np.uint8)]
                at = np.arange(r["n"])
                columns = [Sums(names, base).of(at, at + LENGTH).view(np.int64) for base in BASES]
                columns += [np.full(len(at), r[c]) for c in ("k", "g", "weight")] + [at + r["skip"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d1", "d2", "k", "g", "weight", "start"])

    windows = blocks.mapInArrow(rows, "d1 long, d2 long, k long, g long, weight long, start long")
    often = windows.groupBy(F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.sum("weight").alias("times")).where("times > 1")
    found = windows.join(often, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left_semi")
    return found.select("k", "g", "start", (F.col("start") + LENGTH).alias("end"))


def block_texts(texts: DataFrame) -> DataFrame:
    """``(k, g, weight, n, crowd, bytes)``: the bytes that the windows of each block in ``found`` cover."""
    names = ("k", "g", "weight", "n", "crowd")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(text_bytes(batch)):
                if text_id(data) != batch.column("tid")[k].as_py():
                    continue
                flat = batch.column("found")[k].values
                parts = [data[p : p + n + LENGTH - 1] for p, n in zip(flat.field("pos").to_pylist(), flat.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in names], pa.array(parts, pa.binary())], names=[*names, "bytes"])

    # repeated rows are one document
    return texts.mapInArrow(rows, "k long, g long, weight long, n long, crowd boolean, bytes binary").dropDuplicates(["k", "g"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tid, spans)``: the bytes of each document in LENGTH-byte strings that also start elsewhere; documents without any are left out."""
    named = identified(docs, id_col, text_col)
    shared = shared_blocks(block_table(named, byte_blocks, bytes, LENGTH, CHUNK, "byte-blocks"), "byte")
    classes = classes_of(shared, "byte")
    kinds = classes.groupBy(F.col("k").alias("of_k")).agg(F.count(F.lit(1)).alias("kinds"), F.max("copied").alias("any_copied"))
    wanted = classes.join(kinds, F.col("k") == F.col("of_k")).where("kinds > 1 or any_copied")
    wanted = wanted.select(
        "k", "g", "n", "first.id", "first.tid", "first.pos", (F.col("copied").cast("long") + 1).alias("weight"), (F.col("kinds") > CROWD).alias("crowd")
    )
    blocks = store(block_texts(with_text(named, wanted, "k g weight n crowd pos", "byte")), "byte-texts")
    few, many = (blocks.where(c).drop("crowd") for c in ("not crowd", "crowd"))
    found = merged_repeats(few.withColumn("skip", F.lit(0).cast("long"))).unionByName(crowd_repeats(many))
    of_class = store(found, "byte-repeats").select(F.col("k").alias("of_k"), F.col("g").alias("of_g"), "start", "end")
    spans = shared.join(of_class, (F.col("k") == F.col("of_k")) & (F.col("g") == F.col("of_g"))).select(
        "id", "tid", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end")
    )
    return spans_by_document(spans, "byte-spans")


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row; ``kept`` is the other bytes as text, or their SHA-256 if ``digest``.

    Null texts are empty; rows that repeat id and text (a null id too) are one document, so they are no copies of each other;
    rows that repeat an id alone are told apart by a hash of their text. An empty table gives no rows.
    """
    spans = repeated_bytes(docs, id_col, text_col)

    def edit(data: bytes, starts, ends) -> tuple[int, int, int, str]:
        kept, at = [], 0
        for s, e in zip(*(([], []) if starts is None else (starts.tolist(), ends.tolist()))):
            kept.append(data[at:s])
            at = e
        kept.append(data[at:])
        left = b"".join(kept)
        told = hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace")
        return len(data), len(data) - len(left), 0 if starts is None else len(starts), told

    return apply_spans(docs, spans, edit, "n_bytes long, n_removed long, n_spans long, kept string", id_col, text_col, "byte-kept")
