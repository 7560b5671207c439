"""Joins by key and by record range, checks against manifests and member lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.carry import with_latest
from batchloom.operators.pooling import pooled_lists
from batchloom.session import cut, scratch

HOT_ROWS = 100_000  # a key with more rows may be dealt to several tasks


SAMPLE = 0.01


def hot_keys(rows: DataFrame, key: str, least: int = HOT_ROWS, most: int = 1000) -> list:
    """The most frequent keys of a sample that stand for more than ``least`` rows, ``most`` of them at most."""
    counts = rows.where(F.col(key).isNotNull()).select(key).sample(SAMPLE, seed=1).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    often = counts.where(F.col("_n") > least * SAMPLE).orderBy(F.desc("_n"), key).limit(most)
    return [r[0] for r in often.select(key).collect()]


def skewed_lookup(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", salts: int = 64, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Look up ``table``, which has one row per key, for rows in which some keys are very frequent.

    The rows of hot keys and of the null key are dealt to ``salts`` tasks, and only the hot entries of the table are
    repeated that often. Hot keys are those of a sample, as a list that both sides read, so neither is joined once more. What is in the list, ``salts``
    and ``hot_rows`` change the spreading alone. Spark broadcasts the table if its bytes allow it.
    """
    hot, none = hot_keys(rows, key, hot_rows), F.lit(0).cast("bigint")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    deal = F.when(is_hot | F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(none)
    every = F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")
    spread = table.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(none))))
    return rows.withColumn("_salt", deal).join(spread, [key, "_salt"], how).drop("_salt")


def vocab_lookup(docs: DataFrame, doc: str, words: Column, vocabulary: DataFrame, unknown: str = "[UNK]", **spreading) -> DataFrame:
    """Word ids of each document in word order; unknown words get the id of ``[UNK]``.

    ``vocabulary`` has the columns ``word`` and ``id``; ``spreading`` goes to :func:`skewed_lookup`.
    """
    unk = vocabulary.where(F.col("word") == unknown).select("id").scalar()
    tokens = docs.select(doc, F.posexplode(words).alias("_pos", "word"))
    found = skewed_lookup(tokens, vocabulary, "word", **spreading).withColumn("id", F.coalesce("id", unk))
    ids = found.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("_pos", "id")))["id"].alias("ids"))
    return docs.join(ids, doc, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def embedding_lookup_pool(
    rows: DataFrame, row: str, slots: Sequence[str], dense: str, table: DataFrame, dim: int, **spreading
) -> DataFrame:
    """Average embedding of the ids in each slot, in slot order, followed by the row's dense numbers.

    ``table`` has the columns ``id`` and ``vec``. A slot whose ids are all unknown gives zeros; rows without a key are left out.
    """
    pooled = pooled_lists(rows.where(F.col(row).isNotNull()), row, slots, table, dim, "_f", **spreading)
    return pooled.withColumn("features", F.concat("_f", F.col(dense).cast("array<double>"))).drop("_f")


def kv_multi_get(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Value of each requested key; null when the table does not hold it."""
    return skewed_lookup(keys, table, key)


def check_against_manifest(client: DataFrame, server: DataFrame, idx: str, path: str, strict: bool = False) -> DataFrame:
    """Entries that differ between two file lists; in strict mode such an entry is an error."""
    ours = client.select(F.col(idx).alias("idx"), F.col(path).alias("client_path"))
    theirs = server.select(F.col(idx).alias("idx"), F.col(path).alias("server_path"))
    wrong = ours.join(theirs, "idx", "full").where(~F.col("client_path").eqNullSafe(F.col("server_path")))
    if strict:
        text = F.concat(F.lit("file list differs at "), F.col("idx").cast("string"))
        wrong = wrong.withColumn("client_path", F.raise_error(text).cast("string"))
    return wrong


def skip_processed_records(records: DataFrame, processed: DataFrame, file: str, record: str) -> DataFrame:
    """The records outside the processed ranges ``(file, begin, end)``, which are merged and inclusive."""
    marks = cut(processed).select(file, F.col("begin").alias(record), F.struct("begin", "end").alias("_range"))
    placed = with_latest(records, marks, [file], record, "_range")
    return placed.where(F.coalesce(F.col(record) > F.col("_range.end"), F.lit(True))).drop("_range")


def unfinished_files(manifest: DataFrame, processed: DataFrame, file: str) -> DataFrame:
    """``(file, first, last, reach)`` of each file of the manifest ``(file, first, last)``: records up to ``reach`` are processed.

    ``processed`` has merged ranges, so only the first range of a file can cover all of it. ``reach`` is before ``first`` if
    the first record is still to come. Files with ``reach`` at or past ``last`` are finished, and so are files without records.
    """
    earliest = processed.groupBy(file).agg(F.min(F.struct("begin", "end")).alias("_range"))
    reach = F.when(F.col("_range.begin") <= F.col("first"), F.col("_range.end"))
    return manifest.join(earliest, file, "left").select(file, "first", "last", F.coalesce(reach, F.col("first") - 1).alias("reach"))


def skip_finished_files(records: DataFrame, manifest: DataFrame, processed: DataFrame, file: str, record: str) -> DataFrame:
    """As :func:`skip_processed_records`, for records in folders by ``file``: files whose records are all processed are not opened.

    The state of the files is written first, so Spark knows its size; while the open files fit a broadcast they prune the folders
    of ``records`` when the job runs, past that they are joined. No list of files passes the driver's program.
    """
    spark, path = records.sparkSession, scratch(records.sparkSession, "progress")
    state = unfinished_files(manifest, processed, file)
    state.write.parquet(path)
    files = spark.read.schema(state.schema).parquet(path).where(F.col("reach") < F.col("last")).select(file)
    return skip_processed_records(records.join(files, file), processed.join(files, file, "left_semi"), file, record)


def record_range_lookup(records: DataFrame, chunks: DataFrame, file: str, record: str, width: int = 1024) -> DataFrame:
    """Records of each requested chunk ``(file, begin, end, ...)``, bounds inclusive; chunks may overlap.

    A chunk is cut into slices of ``width``, or of 16, 256, ... times that if it is wider, so that it gives 17 slices or so;
    records meet it on their slice of each width that some chunk has.
    """
    wide = F.ceil(F.log(16.0, (F.col("end") - F.col("begin") + 1) / float(width)))
    levelled = chunks.withColumn("_level", F.coalesce(F.greatest(wide, F.lit(0)), F.lit(0)).cast("int"))
    slice_of = f"div shiftleft({width}L, 4 * _level)"
    slices = levelled.withColumn("_slice", F.explode(F.sequence(F.expr(f"begin {slice_of}"), F.expr(f"end {slice_of}"))))
    levels = levelled.agg(F.collect_set("_level")).scalar()  # 14 at most
    placed = records.withColumn("_level", F.explode(levels)).withColumn("_slice", F.expr(f"`{record}` {slice_of}"))
    met = placed.join(slices, [file, "_level", "_slice"])
    return met.where(F.col(record).between(F.col("begin"), F.col("end"))).drop("_slice", "_level")


def fetch_batches(metas: DataFrame, batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch data for the batch ids a consumer was given."""
    return metas.join(batches, list(keys))


def attach_predictions(inputs: DataFrame, predictions: DataFrame, task: str = "task_id", place: str = "place") -> DataFrame:
    """Match teacher output to its input by task and place in the task."""
    return inputs.join(predictions, [task, place])


def leader_lookup(jobs: DataFrame, leader: str, pods: DataFrame, pod: str) -> DataFrame:
    """The pod row of each leader; ``found`` is false when the leader is not among the pods."""
    known = pods.withColumn("_known", F.lit(True))
    joined = jobs.join(known, F.col(leader) == F.col(pod), "left")
    return joined.withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


def known_members_only(readers: DataFrame, pods: DataFrame, member: str) -> DataFrame:
    """Readers that belong to the cluster, and the members that only one side knows, marked by ``side``."""
    ours = readers.select(member).distinct().withColumn("_r", F.lit(True))
    theirs = pods.select(member).distinct().withColumn("_p", F.lit(True))
    side = F.when(F.col("_p").isNull(), "reader").when(F.col("_r").isNull(), "pod").otherwise("both")
    return ours.join(theirs, member, "full").select(member, side.alias("side"))
