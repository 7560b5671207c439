"""Counts, status reports, job tables and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.functions.scalars import cpu_quantity, epoch_micros
from batchloom.operators.pooling import pooled_lists
from batchloom.operators.positions import grouped_positions, range_positions
from batchloom.session import scratch

ROLES = ("master", "pserver", "trainer")  # fixed values: the roles of a job's pods


def queue_sizes(batches: DataFrame, pod: str) -> DataFrame:
    """Batches per pod next to the total and the average over pods."""
    sizes = batches.groupBy(pod).agg(F.count(F.lit(1)).alias("size"))
    return sizes.select(pod, "size", sizes.agg(F.sum("size")).scalar().alias("total"), sizes.agg(F.avg("size")).scalar().alias("average"))


def barrier_complete(reports: DataFrame, ended: DataFrame, members: DataFrame, stage: str, member: str) -> DataFrame:
    """Per stage in the reports: have all expected members reported or ended, and how many are missing.

    ``members`` holds the expected members, ``ended`` those at their end. What is missing is counted, so the members are not
    multiplied by the stages.
    """
    done = ended.select(member).distinct().withColumn("_e", F.lit(True))
    expected = members.select(member).distinct().join(done, member, "left")
    still = expected.where(F.col("_e").isNull()).select(member, F.lit(True).alias("_o"))
    arrived = reports.select(stage, member).distinct().join(still, member, "left").groupBy(stage).agg(F.count("_o").alias("_here"))
    wanted = expected.agg(F.struct(F.count(F.lit(1)).alias("all"), F.count_if(F.col("_e").isNull()).alias("open"))).scalar()
    missing = F.col("_w.open") - F.col("_here")
    return arrived.withColumn("_w", wanted).select(
        stage, F.col("_w.all").alias("expected"), missing.alias("missing"), (missing == 0).alias("complete")
    )


def all_reach_end(df: DataFrame, ended: Column, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(F.bool_and(ended).alias("all_ended"))


def status_sets(df: DataFrame, status: Column, member: str) -> DataFrame:
    """The members of each status as a set of rows; a set may be too large for one array."""
    return df.select(status.alias("status"), member).distinct()


def phase_counts(pods: DataFrame, job: str, role: str, phase: str) -> DataFrame:
    """Pods per job, role and phase."""
    return pods.groupBy(job, role, phase).agg(F.count(F.lit(1)).alias("n"))


def job_phase_table(pods: DataFrame, job: str, role: str, phase: str) -> DataFrame:
    """One row per job with a column per role: the role's phases with their number of pods."""
    text = F.concat_ws(":", F.col(phase), F.col("n").cast("string"))
    pivoted = phase_counts(pods, job, role, phase).groupBy(job).pivot(role, list(ROLES))
    # few phases exist, so the lists are short
    return pivoted.agg(F.array_join(F.sort_array(F.collect_list(text)), ","))


def _job_flags(pods: DataFrame, job: str, role: str, phase: str) -> DataFrame:
    blocked = F.col(role).isin("master", "pserver") & (F.col(phase) == "Pending")
    trainer = F.col(role) == "trainer"
    return pods.groupBy(job).agg(
        F.bool_or(blocked).alias("blocked"),
        F.count_if(trainer & (F.col(phase) == "Running")).alias("running"),
        F.count_if(trainer).alias("trainers"),
        F.count_if(trainer & (F.col(phase) == "Pending")).alias("pending"),
    )


def running_trainers(pods: DataFrame, job: str, role: str, phase: str) -> DataFrame:
    """Running trainers per job, none while its master or a parameter server is pending, with the report text."""
    running = F.when(F.col("blocked"), 0).otherwise(F.col("running")).cast("bigint")
    flags = _job_flags(pods, job, role, phase).select(job, running.alias("running"))
    return flags.withColumn("report", F.concat_ws(":", F.col(job).cast("string"), F.col("running").cast("string")))


def submitted_pending_jobs(pods: DataFrame, job: str, role: str, phase: str) -> DataFrame:
    """Number of jobs, and of those that wait: blocked, without trainers, or with pending trainers only."""
    waits = F.col("blocked") | (F.col("pending") == F.col("trainers"))
    return _job_flags(pods, job, role, phase).agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if(waits).alias("pending")
    )


def utilisation(pods: DataFrame, phase: str, requested: Column, allocatable: Column, group: Sequence[str] = ()) -> DataFrame:
    """Requests of running pods in percent of what can be allocated, as text with two decimals; 0 without capacity."""
    used = F.sum(F.when(F.col(phase) == "Running", requested).otherwise(0))
    percent = F.when(allocatable > 0, F.format_string("%.2f", 100.0 * F.col("_used") / allocatable)).otherwise("0")
    return pods.groupBy(*group).agg(used.alias("_used")).select(*group, percent.alias("utilisation"))


def container_requests(containers: Column) -> tuple[Column, Column]:
    """Thousandths of a CPU and GPUs that the containers ``(cpu, gpu)`` of a pod ask for; a CPU text is ``2`` or ``250m``, absent is 0."""
    none = F.lit(0).cast("bigint")
    cpu = F.aggregate(containers, none, lambda a, c: a + F.round(cpu_quantity(c["cpu"]) * 1000).cast("bigint"))
    gpu = F.aggregate(containers, none, lambda a, c: a + F.coalesce(c["gpu"], none))
    return F.coalesce(cpu, none), F.coalesce(gpu, none)


def run_summary(scores: DataFrame, run: str, score: str) -> DataFrame:
    """Best score of each run, next to the average and the maximum over runs."""
    best = scores.groupBy(run).agg(F.max(score).alias("best"))
    return best.select("*", best.agg(F.avg("best")).scalar().alias("mean_best"), best.agg(F.max("best")).scalar().alias("max_best"))


def label_rank(scores: Column, label: Column) -> Column:
    """Rank of the label's score from 0; equal scores rank by class number."""
    own = F.get(scores, label)
    before = F.transform(scores, lambda s, i: (s > own) | ((s == own) & (i < label)))
    return F.size(F.filter(before, lambda b: b))


def topk_accuracy(df: DataFrame, scores: Column, label: Column, ks: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose label is among the k highest scores."""
    ranked = df.withColumn("_rank", label_rank(scores, label))
    shares = [F.avg((F.col("_rank") < k).cast("double")).alias(f"acc{k}") for k in ks]
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *shares)


def argmax(scores: Column) -> Column:
    """Number of the highest score, from 0; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confusion_counts(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    return df.groupBy(label.cast("int").alias("label"), predicted.cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def macro_f1_accuracy(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """Mean F1 over the classes that occur, and the share of right answers."""
    hit = F.col("label") == F.col("predicted")
    parts = F.when(hit, F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("tp"), F.lit(0).cast("bigint").alias("miss")))).otherwise(
        F.array(
            F.struct(F.col("label").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("miss")),
            F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("miss")),
        )
    )
    per_class = confusion_counts(df, label, predicted).select(F.inline(parts)).groupBy("c").agg(
        F.sum("tp").alias("tp"), F.sum("miss").alias("miss")
    )
    # every miss is counted twice: once at the true class, once at the predicted one
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("miss"))).otherwise(0.0)
    return per_class.agg(
        F.avg(f1).alias("macro_f1"),
        (F.sum("tp") / (F.sum("tp") + F.sum("miss") / 2)).alias("accuracy"),
    )


def score_buckets(
    df: DataFrame, score: Column, positive: Column, thresholds: int, group: Sequence[str | Column] = ()
) -> DataFrame:
    """Positive and negative rows per score bucket."""
    return df.groupBy(*group, F.floor(score * thresholds).cast("int").alias("bucket")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def auc_of_buckets(buckets: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids; null when a class is absent.

    The window runs over the buckets of a group, one row per threshold at most.
    """
    higher = Window.partitionBy(*group).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("neg") * (F.coalesce(F.sum("pos").over(higher), F.lit(0)) + F.col("pos") / 2)
    sums = buckets.withColumn("_area", area).groupBy(*group).agg(
        F.sum("_area").alias("_area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    both = F.col("n_pos") * F.col("n_neg")
    return sums.select(*group, "n_pos", "n_neg", F.when(both > 0, F.col("_area") / both).alias("auc"))


def auc_histogram(df: DataFrame, score: Column, positive: Column, thresholds: int = 4096, group: Sequence[str] = ()) -> DataFrame:
    return auc_of_buckets(score_buckets(df, score, positive, thresholds, group), group)


def sliding_auc(df: DataFrame, step: str, score: Column, positive: Column, steps: int = 20, thresholds: int = 4096) -> DataFrame:
    """AUC at each step over the rows of the last ``steps`` steps, from running bucket counts.

    Steps come in blocks of ``4 * steps``. A block also gets the ``steps - 1`` steps before it, so a count is copied once at most;
    what enters a step is added to the running counts and what leaves it is taken off. A task holds the counts of ``5 * steps`` steps.
    """
    width = 4 * steps
    buckets = score_buckets(df, score, positive, thresholds, [F.col(step).cast("bigint").alias("step")])
    blocks = F.array_distinct(F.array(F.floor(F.col("step") / width), F.floor((F.col("step") + (steps - 1)) / width)))
    lowest = F.coalesce("bucket", F.lit(-(1 << 31)))  # rows without a score
    placed = buckets.select(F.explode(blocks).alias("block"), "step", lowest.alias("bucket"), "pos", "neg")

    def slide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("step")
        at, pos, neg = (rows[c].to_numpy() for c in ("step", "pos", "neg"))
        values, place = np.unique(rows["bucket"].to_numpy(), return_inverse=True)
        running, found = np.zeros((2, len(values)), np.int64), []
        present, starts = np.unique(at, return_index=True)
        ends, oldest = [*starts[1:], len(at)], 0
        for now, start, end in zip(present.tolist(), starts, ends):
            running[:, place[start:end]] += (pos[start:end], neg[start:end])
            while present[oldest] <= now - steps:
                gone = slice(starts[oldest], ends[oldest])
                running[:, place[gone]] -= (pos[gone], neg[gone])
                oldest += 1
            if now // width != rows["block"][0].as_py():
                continue
            n_pos, n_neg = running.sum(axis=1).tolist()
            above = n_pos - np.cumsum(running[0])
            area = float(running[1] @ above) + float(running[1] @ running[0]) / 2
            found.append((now, n_pos, n_neg, area / (n_pos * n_neg) if n_pos * n_neg else None))
        columns = list(zip(*found)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["step", "n_pos", "n_neg", "auc"])

    found = placed.groupBy("block").applyInArrow(slide, "step bigint, n_pos bigint, n_neg bigint, auc double")
    return found.select(F.col("step").cast(dict(df.dtypes)[step]).alias(step), "n_pos", "n_neg", "auc")


def epoch_means(df: DataFrame, epoch: Column, batch: Column, values: Sequence[str]) -> DataFrame:
    """Mean over batches of each batch's mean."""
    batches = df.groupBy(epoch.alias("epoch"), batch.alias("batch")).agg(*[F.avg(v).alias(v) for v in values])
    return batches.groupBy("epoch").agg(F.count(F.lit(1)).alias("batches"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def median(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str], pair_takes_larger: bool = True) -> DataFrame:
    """Exact middle value per group; of two values the larger one, otherwise the mean of the two middles.

    A hot group is sorted over many tasks, then its one or two middle rows are picked.
    """
    placed = grouped_positions(df.select(*group, value, *ties), group, [value, *ties], "_pos")
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    low = F.expr("(n - 1) div 2")
    if pair_takes_larger:
        low = F.when(F.col("n") == 2, 1).otherwise(low)
    middle = placed.join(counts, list(group)).where(F.col("_pos").between(low, F.expr("n div 2")))
    return middle.groupBy(*group).agg(F.max("n").alias("n"), F.avg(value).alias("median"))


def throughput(df: DataFrame, epoch: Column, ts: str, batch_size: int) -> DataFrame:
    """Rows per second of each pass, counting each row as a batch."""
    seconds = (F.max(epoch_micros(F.col(ts))) - F.min(epoch_micros(F.col(ts)))) / 1e6
    return df.groupBy(epoch.alias("epoch")).agg(F.count(F.lit(1)).alias("batches"), seconds.alias("seconds")).withColumn(
        "speed", F.when(F.col("seconds") > 0, F.col("batches") * batch_size / F.col("seconds"))
    )


def epoch_attributes(df: DataFrame, epoch: Column, worker: str, step_time: Column) -> DataFrame:
    """Workers, steps and mean step time of each epoch."""
    return df.groupBy(epoch.alias("epoch_no")).agg(
        F.count_distinct(worker).alias("world_size"),
        F.count(F.lit(1)).alias("step_num"),
        F.avg(step_time).alias("avg_step_time"),
    )


def build_vocabulary(docs: DataFrame, words: Column, min_count: int = 1) -> DataFrame:
    """Words with their count and an id by falling count, then by text."""
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return range_positions(counts.where(F.col("n") >= min_count), [F.desc("n"), "word"], "id")


def bag_of_words_pool(ids: DataFrame, doc: str, id_col: str, table: DataFrame, dim: int, weights: Sequence[Sequence[float]]) -> DataFrame:
    """Sum of the embeddings of a document's ids (0 is padding), softsign, then a linear layer to logits.

    The ids of a document become one list, written once; a document without a key has none.
    """
    spark, path = ids.sparkSession, scratch(ids.sparkSession, "bags")
    real = F.when((F.col(id_col) != 0) & F.col(doc).isNotNull(), F.col(id_col))
    bags = ids.groupBy(doc).agg(F.collect_list(real).alias("_ids"))
    bags.write.parquet(path)
    pooled = pooled_lists(spark.read.schema(bags.schema).parquet(path), doc, ["_ids"], table, dim, "vec", mean=False)
    soft = F.transform("vec", lambda x: x / (1 + F.abs(x)))
    lit = [F.array(*[F.lit(float(w)) for w in row]) for row in weights]
    layers = [F.aggregate(F.zip_with("_soft", row, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for row in lit]
    return pooled.withColumn("_soft", soft).select(doc, F.array(*layers).alias("logits"))
