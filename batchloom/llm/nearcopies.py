"""Near-copies by SimHash: wide limits of the pigeonhole join, candidates verified by a second fingerprint of five-word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import components, forest, shuffle_partitions, slices, store, text_bytes, text_ref, whole_groups
from batchloom.llm.simhash import fingerprint, majority, plan_masks

WIDTH = 5
WORDS = 4  # 64-bit words of the second fingerprint
BLOCK = 4096  # members of a bucket that are compared in one piece; larger buckets are compared piece by piece
ROW_COST = 1000  # of shuffling a row with both fingerprints, in comparisons
SLACK = 4  # bits that a pair of the wanted similarity may be above the average
HELD = 1 << 20  # links that are gathered before they become a forest
# The increment and multipliers of the SplitMix64 generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def spread_bits(hashes: np.ndarray, stream: int) -> np.ndarray:
    """The hashes under one of several independent mixings."""
    z = hashes + np.uint64(STEP * (stream + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def shingle_print(data: bytes) -> bytes:
    """256-bit fingerprint of the set of five-word shingles of the ASCII-lower-cased words; zero without words."""
    words = data.lower().split()
    if not words:
        return bytes(8 * WORDS)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = max(1, len(words) - WIDTH + 1)
    starts, ends = (ends - lengths)[:last].tolist(), ends[min(WIDTH, len(words)) - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.unique(np.array([digest(view[s:e], 42) for s, e in zip(starts, ends)], np.uint64))
    return b"".join(majority(spread_bits(hashes, k)).to_bytes(8, "little") for k in range(WORDS))


def bits_apart(similarity: float) -> int:
    """Bits of the second fingerprint in which two sets of this Jaccard similarity differ on average, rounded.

    A bit differs with the angle of the two sets over pi; the cosine of sets of one size is 2s / (1 + s).
    """
    return round(64 * WORDS * acos(2 * similarity / (1 + similarity)) / pi)


def linked(group: np.ndarray, values: np.ndarray, wide: np.ndarray, limit: int, sure: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links inside the runs of equal (sorted) ``group``.

    Rows link at ``sure`` or fewer differing bits, or at ``limit`` if their second fingerprints differ in ``far`` bits at most.
    """
    none = np.zeros(0, np.int64)
    left, right, held = [none], [none], 0
    at = np.arange(len(values))

    def collapsed():
        a, b = np.concatenate(left), np.concatenate(right)
        root = forest(a, b, len(values))
        away = np.flatnonzero(root != np.arange(len(values)))
        return away, root[away]

    for step in range(1, len(values)):
        at = at[at + step < len(values)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        bits = np.bitwise_count(values[at] ^ values[at + step])
        near = np.flatnonzero(bits <= limit)
        apart = np.bitwise_count(wide[at[near]] ^ wide[at[near] + step]).sum(axis=1, dtype=np.int64)
        met = at[near[(bits[near] <= sure) | (apart <= far)]]
        left.append(met)
        right.append(met + step)
        held += len(met)
        if held > HELD:
            a, b = collapsed()
            left, right, held = [a], [b], 0
    return collapsed()


def copy_links(rows: DataFrame, limit: int, sure: int, far: int) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that connect what is linked inside each bucket of ``(key, fp, wide)``.

    Buckets of one go first. A larger one is cut into blocks of about BLOCK members by a hash of the member, and every
    two blocks meet in a task of their own, which gives a spanning forest of its links.
    """
    sizes = rows.groupBy(F.col("key").alias("of_key")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    block = F.pmod(F.xxhash64("fp", "wide"), F.col("blocks")).cast("int")
    sized = rows.join(sizes, F.col("key") == F.col("of_key")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    met = (
        sized.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "fp", "wide")
    )

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            values = table["fp"].to_numpy()
            wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint64).reshape(-1, WORDS)
            a, b = linked(table["task"].to_numpy(), values.view(np.uint64), wide, limit, sure, far)
            yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], names=["a", "b"])

    parts = shuffle_partitions(rows.sparkSession)
    dealt = met.repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(links, "a long, b long").where("a <> b").distinct()


def copy_roots(prints: DataFrame, limit: int, sure: int, far: int) -> DataFrame:
    """``(node, root)`` of the fingerprints of ``prints`` that links lead to a smaller one."""
    variants = store(prints.select("fp", "wide").distinct(), "variants")
    masks = plan_masks(variants.select("fp").distinct(), limit, ROW_COST)
    if not masks:
        return prints.sparkSession.createDataFrame([], "node long, root long")
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)]))
    probed = variants.select("fp", "wide", probes.alias("p"))
    rows = probed.select(F.xxhash64("p.i", F.col("fp").bitwiseAND(F.col("p.mask"))).alias("key"), "fp", "wide")
    return components(copy_links(rows, limit, sure, far))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, limit: int = 9, sure: int = 3
) -> DataFrame:
    """One row of ``docs`` of each component: the one with the smallest id, and of rows with that id the first by a hash of the text.

    Two texts link if their 64-bit fingerprints of three-word shingles differ in ``sure`` bits at most, or in ``limit`` bits and their
    256-bit fingerprints of five-word shingles in SLACK bits more, at most, than sets of this Jaccard similarity do on average. Null and
    word-less texts are alike. Texts are read whole, however long. Rows without an id come after all others. Rows are told
    apart by id and text; of rows that repeat both one stays. Any other columns may have any names. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = text_bytes(batch)
            values = pa.array(np.array([fingerprint(x) for x in data], np.uint64).view(np.int64))
            wide = pa.array([shingle_print(x) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ref"), values, wide], names=["doc_id", "ref", "fp", "wide"])

    marked = texts.withColumn("ref", text_ref(F.col("text"))).mapInArrow(rows, f"doc_id {kind}, ref binary, fp long, wide binary")
    prints = store(marked, "prints")
    found = copy_roots(prints, limit, sure, bits_apart(similarity) + SLACK)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ref")
    nodes = prints.groupBy("fp").agg(F.min(place).alias("first"))
    rooted = store(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("first").alias("least"))
    named = rooted.join(least, F.col("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "least")
    stays = place.eqNullSafe(F.col("least"))
    decided = prints.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "ref", stays.alias("stays"))
    decided = store(decided.groupBy("doc_id", "ref", "stays").agg(F.count(F.lit(1)).alias("n")), "found")  # equal rows share their verdict
    touched = decided.where("not stays or n > 1")
    match = docs[id_col].eqNullSafe(touched["doc_id"]) & (text_ref(docs[text_col]) == touched["ref"])
    kept = docs.alias("d").join(touched.alias("t"), match, "left").where(F.coalesce("t.stays", F.lit(True)))
    rows_kept = kept.select(F.struct("d.*").alias("row"), F.col("t.doc_id").alias("id"), F.col("t.ref").alias("ref"))
    once = rows_kept.where("ref is null").select("row.*")
    return once.unionByName(rows_kept.where("ref is not null").dropDuplicates(["id", "ref"]).select("row.*"))
