"""Metrics along steps and versions, without a window over a whole group of data rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.functions.scalars import epoch_micros
from batchloom.operators.carry import id_block, with_previous
from batchloom.operators.positions import grouped_positions, id_positions


def ngram_samples(docs: DataFrame, doc: str, words: Column, n: int = 5) -> DataFrame:
    """Every run of ``n`` words: the first n - 1 as context, the last as the word to predict."""
    tokens = docs.select(doc, words.alias("_w")).where(F.size("_w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.slice("_w", i, n))
    return tokens.select(doc, F.posexplode(runs).alias("pos", "_run")).select(
        doc, "pos", F.slice("_run", 1, n - 1).alias("context"), F.element_at("_run", -1).alias("next_word")
    )


def every_n_steps_mean(df: DataFrame, run: str, step_id: str, ts: str, n: int, batch_size: int) -> DataFrame:
    """Mean step period and speed of each run at its steps 0, n, 2n, ...; a step's period runs from the step before."""
    steps = id_positions(df.select(run, step_id, ts), step_id, [run], "step")
    timed = with_previous(steps, {ts: "_before"}, [run], [step_id], id_block(step_id))
    span = epoch_micros(F.col(ts)) - epoch_micros(F.col("_before"))
    marks = timed.withColumn("_us", span).groupBy(run, F.expr(f"(step + {n - 1}) div {n} * {n}").alias("step"))
    means = marks.agg(F.count("_us").alias("steps"), (F.sum("_us") / F.count("_us") / 1e6).alias("period"))
    return means.where(F.col("steps") > 0).withColumn("speed", F.lit(float(batch_size)) / F.col("period"))


def op_durations(df: DataFrame, process: str, op: str, ts: str, order: Sequence[str], block: Column) -> DataFrame:
    """Milliseconds since the process's previous record; null for its first one."""
    timed = with_previous(df, {ts: "_before"}, [process], order, block)
    span = epoch_micros(F.col(ts)) - epoch_micros(F.col("_before"))
    return timed.withColumn("ms", span / 1000.0).drop("_before")


def best_so_far(scores: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Running maximum along the epochs of a run; ``scores`` has one row per run and epoch."""
    return scores.withColumn("best", F.max(score).over(Window.partitionBy(run).orderBy(epoch)))


def membership_changed(members: DataFrame, job: str, version: str, stage: Column, member: str) -> DataFrame:
    """Per snapshot after the first: members added and removed, and whether the stage or the members changed.

    Each member row is compared with the next snapshot by adding +1 and -1, so no member list is built.
    """
    rows = members.select(job, version, stage.alias("_stage"), member).distinct()
    # one row per snapshot
    along = Window.partitionBy(job).orderBy(version)
    snapshots = rows.groupBy(job, version).agg(F.max("_stage").alias("_stage")).select(
        job, version, "_stage", F.lag("_stage").over(along).alias("_old_stage"), F.lead(version).over(along).alias("_next")
    )
    signs = F.array(
        F.struct(F.col(version).alias("v"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("v"), F.lit(-1).alias("sign"))
    )
    signed = rows.select(job, version, member).join(snapshots.select(job, version, "_next"), [job, version])
    moves = signed.select(job, member, F.inline(signs)).where(F.col("v").isNotNull())
    net = moves.groupBy(job, "v", member).agg(F.sum("sign").alias("net"))
    counts = net.groupBy(job, F.col("v").alias(version)).agg(
        F.count_if(F.col("net") > 0).alias("added"), F.count_if(F.col("net") < 0).alias("removed")
    )
    later = snapshots.where(F.col("_old_stage").isNotNull())
    changed = (F.col("_stage") != F.col("_old_stage")) | (F.col("added") + F.col("removed") > 0)
    return later.join(counts, [job, version]).select(job, version, "added", "removed", changed.alias("changed"))


def pop_n(queue: DataFrame, owner: str, item: str, num: str) -> DataFrame:
    """The first ``num`` items of each queue, all of them when ``num`` is not positive."""
    placed = id_positions(queue, item, [owner], "_pos")
    return placed.where((F.col(num) <= 0) | (F.col("_pos") < F.col(num))).drop("_pos")


def limit_members(members: DataFrame, job: str, member: str, max_nodes: int, salts: int = 64) -> DataFrame:
    """The first members of each job up to ``max_nodes``.

    They are among the first of each salt of the job, so a hot job is sorted in many tasks, and one task sees
    ``salts * max_nodes`` of its members at most.
    """

    def first(rows: DataFrame, *keys) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(member))).where(F.col("_n") <= max_nodes)

    salted = first(members.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(salts))), job, "_salt").drop("_salt", "_n")
    return first(salted, job).withColumn("rank", (F.col("_n") - 1).cast("bigint")).drop("_n")


def sorted_listing(names: DataFrame, group: str, name: str, order_id: str, per_line: int = 64) -> DataFrame:
    """Names per group in their order, equal ones by id, comma-joined in lines of at most ``per_line``."""
    placed = grouped_positions(names, [group], [name, order_id], "_pos").withColumn("line", F.expr(f"_pos div {per_line}"))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("_pos", name)))[name], ",")
    return placed.groupBy(group, "line").agg(F.count(F.lit(1)).alias("n"), joined.alias("listing"))


def endpoints(names: DataFrame, group: str, address: str, order_id: str, port: int, same_port: bool) -> DataFrame:
    """``address:port`` of each name; the port is the same for all or rises with the place of the address in its group."""
    placed = grouped_positions(names, [group], [address, order_id], "_pos")
    number = F.lit(port) if same_port else F.lit(port) + F.col("_pos")
    return placed.withColumn("endpoint", F.concat_ws(":", F.col(address), number.cast("string"))).drop("_pos")


def best_pass(losses: DataFrame, epoch: str, loss: str) -> DataFrame:
    """The pass with the lowest loss, the first of equal ones."""
    return losses.agg(F.min_by(F.struct(epoch, loss), F.struct(loss, epoch)).alias("b")).select(f"b.{epoch}", f"b.{loss}")


def argsort_topk(scores: Column, k: int) -> Column:
    """Class numbers by falling score, the first k; equal scores rank by falling class number."""
    pairs = F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.slice(F.reverse(F.array_sort(pairs)), 1, k)["i"]
