"""Cutting samples into numbered batches and putting them back in order.

A batch is collected into one row only where its size is a parameter. Lists of unknown length stay
rows, or come back in chunks of bounded length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.carry import id_block, with_running
from batchloom.operators.positions import hash_positions, id_positions


def collect_ordered(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str = "rows") -> DataFrame:
    """One row per key group of bounded size, with its rows as an ordered array of structs."""
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(*keys).agg(rows.alias(name))


def number_tasks(df: DataFrame, pos: str, size: int) -> DataFrame:
    """``task_id`` and place in the task of consecutive samples."""
    return df.withColumn("task_id", F.expr(f"`{pos}` div {size}")).withColumn("place", F.expr(f"`{pos}` % {size}"))


def batch_samples(df: DataFrame, id_col: str, columns: Sequence[str], size: int) -> DataFrame:
    """Consecutive samples as tasks of ``size`` (the last one may be short), numbered from 0."""
    placed = number_tasks(id_positions(df, id_col), "pos", size)
    return collect_ordered(placed, ["task_id"], "place", columns)


def shuffled_batches(df: DataFrame, id_col: str, seed: int, columns: Sequence[str], size: int) -> DataFrame:
    """Batches over the seeded shuffle order."""
    placed = number_tasks(seeded_shuffle(df, id_col, seed), "pos", size)
    return collect_ordered(placed, ["task_id"], "place", columns)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int, name: str = "pos") -> DataFrame:
    """Positions of a shuffle that depends on the seed and the id only, so every cluster gives the same one."""
    return hash_positions(df, F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), [id_col], name)


def buffered_shuffle(df: DataFrame, id_col: str, seed: int, buffer: int, name: str = "pos") -> DataFrame:
    """Positions of a shuffle inside a buffer: rows are taken ``buffer`` at a time in the order of their ids and each lot is shuffled.

    So a row moves fewer than ``buffer`` places, and reading ahead by one buffer gives the new order. It depends on seed and ids only.
    """
    placed = id_positions(df, id_col, name="_at").withColumn("_lot", F.expr(f"_at div {buffer}"))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    inside = F.row_number().over(Window.partitionBy("_lot").orderBy("_drawn", id_col)) - 1
    shuffled = placed.withColumn("_drawn", drawn).withColumn(name, F.col("_lot") * buffer + inside)
    return shuffled.drop("_at", "_lot", "_drawn")


def rebatch_lists(df: DataFrame, list_id: str, item: str, size: int) -> DataFrame:
    """Cut each list into tasks that never span two lists; ``task_id`` is dense over all lists.

    ``item`` is a unique integer inside its list. Adds ``pos``, ``list_size``, ``task_id``, ``place``.
    """
    placed = id_positions(df, item, [list_id])
    lists = df.groupBy(list_id).agg(F.count(F.lit(1)).alias("list_size"))
    lists = lists.withColumn("_tasks", F.ceil(F.col("list_size") / size))
    first = with_running(lists, F.col("_tasks"), "_first", [], [list_id], id_block(list_id), include_current=False)
    return (
        placed.join(first, list_id)
        .withColumn("task_id", F.col("_first") + F.expr(f"pos div {size}"))
        .withColumn("place", F.expr(f"pos % {size}"))
        .drop("_first", "_tasks")
    )


def explode_columnar(df: DataFrame, slots: Sequence[str], pos: str = "item") -> DataFrame:
    """Rows of a columnar batch that has one array per slot."""
    keep = [c for c in df.columns if c not in slots]
    zipped = df.select(*keep, F.posexplode(F.arrays_zip(*slots)).alias(pos, "_z"))
    return zipped.select(*keep, F.col(pos).cast("bigint").alias(pos), *[F.col("_z")[s].alias(s) for s in slots])


def restore_order(df: DataFrame, order: Sequence) -> DataFrame:
    """Input order over the partitions and inside them."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def regroup_lists(
    df: DataFrame, list_id: str, pos: str, size: str, columns: Sequence[str], chunk: int = 1024
) -> DataFrame:
    """Rows of tasks back as lists, in chunks of at most ``chunk``, each checked against the list size.

    The rows, which may come out of a teacher, are read once.
    """
    row = F.struct(pos, *[c for c in columns if c != pos])
    lists = df.withColumn("chunk", F.expr(f"`{pos}` div {chunk}")).groupBy(list_id, "chunk").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.max(size).alias("list_size")
    )
    expected = F.least(F.lit(chunk), F.col("list_size") - F.col("chunk") * chunk)
    return lists.withColumn("complete", F.size("rows") == expected)


def to_columnar(df: DataFrame, rows: str, slots: Sequence[str]) -> DataFrame:
    """One array per slot from an array of row structs."""
    arrays = [F.col(rows)[s].alias(s) for s in slots]
    return df.select(*[c for c in df.columns if c != rows], *arrays)


def pad_batch(df: DataFrame, batch: str, ids: str, name: str = "padded", pad: int = 0, max_len: int = -1) -> DataFrame:
    """Right-pad the id lists of a batch to its longest one, or to ``max_len``; nothing is cut off."""
    if max_len > 0:
        length: Column = F.lit(max_len)
    else:
        # a batch has a fixed number of rows
        length = F.max(F.size(ids)).over(Window.partitionBy(batch))
    missing = F.greatest(F.col("_len") - F.size(ids), F.lit(0))
    return df.withColumn("_len", length).withColumn(
        name, F.concat(F.col(ids), F.array_repeat(F.lit(pad).cast("bigint"), missing))
    ).drop("_len")


def make_batch_data(records: DataFrame, producer: str, batch: str, record: str, fields: Sequence[str]) -> DataFrame:
    """One row per batch: id and array of ``(record_no, field_data)``."""
    data = F.array(*[F.col(f).cast("string").cast("binary") for f in fields])
    row = F.struct(F.col(record).alias("record_no"), data.alias("field_data"))
    batches = records.groupBy(producer, batch).agg(F.sort_array(F.collect_list(row)).alias("records"))
    return batches.select(
        producer, F.concat_ws("_", F.col(producer).cast("string"), F.col(batch).cast("string")).alias("batch_data_id"), batch, "records"
    )


def report_batch_meta(
    batches: DataFrame, reader: str, producer: str, batch: str, endpoint: Column, per_report: int = 10
) -> DataFrame:
    """Batch ids in reports of at most ``per_report``; the consumer is not known before balancing."""
    reports = batches.withColumn("report_no", F.expr(f"`{batch}` div {per_report}"))
    ids = F.sort_array(F.collect_list(F.struct(batch, "batch_data_id")))["batch_data_id"]
    return reports.groupBy(producer, "report_no").agg(ids.alias("ids")).select(
        F.lit(reader).alias("reader_name"),
        F.col(producer).cast("string").alias("producer"),
        F.lit(None).cast("string").alias("consumer"),
        endpoint.alias("endpoint"),
        "report_no",
        "ids",
    )


def plan_steps(jobs: DataFrame, images: str, total_batch: int, trainers: int) -> DataFrame:
    """Batch per trainer, steps per pass and images per trainer of each job."""
    per_trainer = total_batch // trainers
    return jobs.select(
        "*",
        F.lit(per_trainer).alias("batch_size"),
        F.ceil(F.col(images) / (per_trainer * trainers)).alias("steps"),
        F.ceil(F.col(images) / trainers).alias("images_per_trainer"),
    )
