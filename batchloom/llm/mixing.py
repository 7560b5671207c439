"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import slices, store, text_bytes
from batchloom.operators.positions import range_positions

EPOCHS = 3
BUCKET_BITS = 14  # a source is cut into so many hash ranges, of which one is sorted
SALTS = 64  # tasks that the rows of one source are dealt over


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(doc_id, source, size)``: words of every row's text."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = pa.array([len(x.split()) for x in text_bytes(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), counts], names=["doc_id", "source", "size"])

    return chosen.mapInArrow(rows, f"doc_id {dict(chosen.dtypes)['doc_id']}, source string, size long")


def rotating_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``weight`` by the place of the source in code point order, null last."""
    placed = range_positions(sources, [F.col("source").asc_nulls_last()], name="place")
    values = F.array(*[F.lit(w) for w in weights])
    return placed.withColumn("weight", F.element_at(values, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``: shares by weight of the sum of all sizes.

    A source whose share is above ``epochs`` times its size is clamped there; the excess goes to the others by weight,
    until none is above. The level, words for each unit of weight, only rises, so each round is one small aggregate.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    clamped, level = -1, (total or 0) / weight if weight else 0.0
    while True:
        over = epochs * F.col("source_size") < F.lit(level) * F.col("weight")
        n, words, heavy = sources.where(over).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n == clamped or not n:
            break
        clamped = n
        if heavy >= weight:
            break
        level = (total - epochs * words) / (weight - heavy)
    most = F.col("source_size") * F.lit(float(epochs))
    return sources.withColumn("target", F.least(most, F.lit(float(level)) * F.col("weight")))


def planned(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: DataFrame | None = None,
    epochs: int = EPOCHS,
    seed: int = 42,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, times, taken)`` for every row: how often the mix takes it.

    ``weights`` has ``(source, weight)``, or weights rotate through 1, 2, 3. Each document is taken ``target div source_size`` times.
    For the rest of the target, documents follow in the order of a seeded hash of their ids until their words come nearest
    to it; so a source misses its target by half a document at most.

    Null sources are one source, null texts have size 0, very long texts are counted whole, rows of one source with equal or null
    ids fall on the same side of the cut, sources without words have target 0 and are not taken, an empty table gives no rows.
    """
    sized = store(sizes(docs, id_col, source_col, text_col), "sizes").withColumn("hash", F.xxhash64(F.lit(seed), F.col("doc_id")))
    sized = sized.withColumn("bucket", F.shiftrightunsigned("hash", 64 - BUCKET_BITS))
    parts = store(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        weighted = rotating_weights(sources)
    else:
        own = weights.select(F.col("source").alias("_source"), "weight")
        weighted = sources.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight")
        )
    filled = water_fill(store(weighted, "weights"), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    whole = F.least(whole, F.lit(epochs)).cast("long")
    goal = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = store(goal, "targets")
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ranges = parts.withColumn("before", running - F.col("words")).join(
        goal.select(F.col("source").alias("g_source"), "rest"), F.col("source").eqNullSafe(F.col("g_source"))
    )
    cut = ranges.where("rest > 0 and before < rest and before + words >= rest").select(
        F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "before", "rest"
    )
    inside = (
        sized.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
        .groupBy("c_source", "c_bucket", "before", "rest", "hash")
        .agg(F.sum("size").alias("size"))
    )
    signless = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))  # signed order of these is the unsigned order of the hashes
    upto = F.sum("size").over(Window.partitionBy("c_source").orderBy(signless))
    near = inside.withColumn("upto", upto + F.col("before")).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = near.groupBy("c_source").agg(F.max(signless).alias("c_last"))
    cuts = cut.select("c_source", "c_bucket").join(
        last.select(F.col("c_source").alias("l_source"), "c_last"), F.col("c_source").eqNullSafe(F.col("l_source")), "left"
    )
    plan = goal.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", "c_bucket", "c_last"
    )
    extra = F.coalesce((F.col("bucket") < F.col("c_bucket")) | ((F.col("bucket") == F.col("c_bucket")) & (signless <= F.col("c_last"))), F.lit(False))
    # the rows of a source are dealt over SALTS tasks, each with a copy of the source's one row
    copies = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = sized.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(
        copies, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("salt") == F.col("p_salt"))
    )
    times = F.col("whole") + extra.cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The plan of :func:`planned` without the sources: ``(doc_id, size, source_size, target, times, taken)``."""
    return planned(docs, id_col, **settings).drop("source")


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows that share id and source are taken alike, as they share a hash."""
    plan = planned(docs, id_col, source_col, **settings)
    times = plan.groupBy("doc_id", "source").agg(F.first("times").cast("int").alias("times")).where("times > 0")
    match = docs[id_col].eqNullSafe(times["doc_id"]) & docs[source_col].cast("string").eqNullSafe(times["source"])
    joined = docs.alias("d").join(times.alias("t"), match)
    copies = joined.select(F.struct("d.*").alias("row"), F.explode(F.sequence(F.lit(1), F.col("t.times"))).alias("copy"))
    return copies.select("row.*")
