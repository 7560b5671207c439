"""SimHash near-duplicates: 64-bit fingerprints, joined by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import components, forest, shuffle_partitions, store, text_bytes, whole_groups

SHINGLE = 3
SAMPLE = 2048  # fingerprints from which correlations and candidate counts are estimated; results don't depend on it
BLOCK = 512  # members of a bucket that are compared in one piece; larger buckets are compared piece by piece
ROW_COST = 40  # of shuffling a row, in comparisons


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[start : start + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = len(bits) // 255 * 255
        ones += np.add.reduce(bits[:cut].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[cut:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes) -> int:
    """Fingerprint of a text: XXH64 (seed 42) of the 3-word shingles of its ASCII-lower-cased words; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    view = memoryview(joined)
    hashes = [digest(view[s:e], 42) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every row's text as a signed 64-bit number."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x) for x in text_bytes(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])

    return chosen.mapInArrow(rows, f"doc_id {dict(chosen.dtypes)['doc_id']}, fp long")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into ``parts`` groups; bits that vary together share a group, so the others stay selective."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits * bits).sum(axis=0)) + 1e-9
    alike = np.abs(bits.T @ bits) / np.outer(spread, spread)
    free, groups = set(range(64)), []
    for part in range(parts):
        width = (64 - sum(map(len, groups))) // (parts - part)
        order = sorted(free)
        group = [max(order, key=lambda b: (alike[b, order].sum(), -b))]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (alike[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def allocate(
    sample: np.ndarray, groups: list[list[int]], rows: int, limit: int, row_cost: int = ROW_COST
) -> tuple[float, list[int]]:
    """Thresholds of the groups, -1 (not probed) and up, that sum to ``limit - parts + 1`` at the least estimated cost.

    Two fingerprints within ``limit`` bits differ by at most its threshold in one group at least. The candidates of a
    group and threshold are estimated from the distances of the sampled pairs; a dynamic programme over the groups
    finds the cheapest sum.
    """
    left, right = np.triu_indices(len(sample), 1)
    scale = rows * (rows - 1) / 2 / max(1, len(left))
    costs = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        near = np.bincount(np.bitwise_count((sample[left] ^ sample[right]) & mask), minlength=65)
        width = len(group)
        cost = {-1: 0.0}
        for t in range(min(limit, width) + 1):
            pairs = sum((near[d] + 0.5 / (1 << min(60, width))) * comb(width - d, t - d) for d in range(t + 1))
            cost[t] = row_cost * rows * comb(width, t) + pairs * scale
        costs.append(cost)
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in cost.items():
                if (now := used + t + 1) <= limit + 1 and (now not in step or total + c < step[now][0]):
                    step[now] = (total + c, [*chosen, t])
        best = step
    return best[limit + 1]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Masks under which two fingerprints that differ by at most its threshold in some group are equal.

    Clearing each choice of ``t`` bits of a group stands for probing all values within ``t`` bits.
    """
    masks = []
    for group, t in zip(groups, thresholds):
        whole = sum(1 << b for b in group)
        if t >= 0:
            masks += [signed(whole - sum(1 << b for b in away)) for away in combinations(group, t)]
    return masks


def plan_masks(prints: DataFrame, limit: int, row_cost: int = ROW_COST) -> list[int]:
    rows = prints.count()
    sampled = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    if rows < 2:
        return []
    plans = []
    for parts in range(2, limit + 2):
        groups = bit_groups(sampled, parts)
        cost, thresholds = allocate(sampled, groups, rows, limit, row_cost)
        plans.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(plans, key=lambda p: p[:2])
    return probe_masks(groups, thresholds)


def linked_pairs(group: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs in the same (sorted) group with at most ``limit`` differing bits."""
    left, right = [], []
    at = np.arange(len(values))
    for step in range(1, len(values)):
        at = at[at + step < len(values)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(values[at] ^ values[at + step]) <= limit]
        left.append(near)
        right.append(near + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def bucket_links(rows: DataFrame, limit: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what is linked inside each bucket of ``(key, fp)``.

    Buckets of one go first. A bucket of more than BLOCK members is cut into blocks by a hash of the member, and every
    two blocks meet in a task of their own. A task gives a spanning forest of the links it finds, never all of them.
    """
    sizes = rows.groupBy(F.col("key").alias("of_key")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sized = rows.join(sizes, F.col("key") == F.col("of_key")).select(
        "key", "fp", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (
        sized.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "fp")
    )

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            values = table["fp"].to_numpy()
            left, right = linked_pairs(table["task"].to_numpy(), values.view(np.uint64), limit)
            nodes, index = np.unique(values, return_inverse=True)
            root = forest(index[left], index[right], len(nodes))
            away = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]])], names=["a", "b"])

    parts = shuffle_partitions(rows.sparkSession)
    return met.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(links, "a long, b long").distinct()


def with_roots(nodes: DataFrame, limit: int) -> DataFrame:
    """``(fp, first, root)`` for the ``(fp, first)`` of ``nodes``: one root for all fingerprints that links reach."""
    masks = plan_masks(nodes, limit)
    if masks:
        probes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)]))
        rows = nodes.select("fp", probes.alias("p")).select(F.xxhash64("p.i", F.col("fp").bitwiseAND(F.col("p.mask"))).alias("key"), "fp")
        found = components(bucket_links(rows, limit))
    else:
        found = nodes.sparkSession.createDataFrame([], "node long, root long")
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: fingerprints link at ``limit`` or fewer differing bits.

    ``component_id`` is the smallest id that is reached over links. Equal fingerprints are one node, so copies cost
    nothing. Null and word-less texts have fingerprint 0 and link like others; rows with a null id get the smallest other id
    of their component, or null; repeated rows keep their own output row; an empty table gives no rows.
    """
    prints = store(fingerprints(docs, id_col, text_col), "prints")
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    rooted = with_roots(nodes, limit)
    least = rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("first").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")
