"""Change feeds: folding, versions, deduplication, fenced writes, snapshots with pending changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.carry import with_previous, with_running
from batchloom.operators.sets import fold_changes
from batchloom.streaming.streams import run_batches


def append_folded(log: str, keys: Sequence[str], op: Column, value: str, revision: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer: fold the batch and put it into its own folder, so a repeated batch replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        fold_changes(batch, keys, op, value, revision).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return each


def watch_changes(
    changes: DataFrame,
    log: str,
    keys: Sequence[str],
    op: Column,
    value: str,
    revision: str,
    start: int = 0,
    checkpoint: str | None = None,
) -> None:
    """Follow a change log from a start revision and append each micro-batch's folded changes to ``log``."""
    run_batches(changes.where(F.col(revision) >= start), append_folded(log, keys, op, value, revision), "watch", checkpoint)


def folded_log(spark: SparkSession, log: str, keys: Sequence[str]) -> DataFrame:
    """The last change of each key over all micro-batches."""
    return fold_changes(spark.read.parquet(log), keys, F.col("op"), "value", "revision")


def versioned_delta(states: DataFrame, key: str, value: str, order: str, block: Column) -> DataFrame:
    """The rows at which a key's value changes, with a version that counts the changes."""
    seen = with_previous(states, {value: "_old"}, [key], [order], block)
    changed = seen.withColumn("_change", F.when(F.col("_old").eqNullSafe(F.col(value)), 0).otherwise(1))
    return with_running(changed, F.col("_change"), "version", [key], [order], block).where(F.col("_change") == 1).drop("_old", "_change")


def newer_than(deltas: DataFrame, clients: DataFrame, key: str, known: str) -> DataFrame:
    """What each client is sent: the newest value, if its version is above the one the client knows."""
    newest = deltas.groupBy(key).agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))
    return clients.join(newest, key).where(F.col("version") > F.col(known))


def stream_versioned_delta(states: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The same on a stream: state per key is the value and its version."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    key_name = key

    class Versions(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("state", "version bigint, value string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            version, old = self.state.get() if self.state.exists() else (0, None)
            frame = pd.concat(list(rows)).sort_values(order)
            out = []
            for n, now in zip(frame[order], frame[value]):
                if now != old:
                    version, old = version + 1, now
                    out.append((key[0], int(n), now, version))
            self.state.update((version, old))
            yield pd.DataFrame(out, columns=[key_name, order, value, "version"])

        def close(self):
            pass

    return states.select(key, order, value).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Versions(),
        outputStructType=f"{key} bigint, {order} bigint, {value} string, version bigint",
        outputMode="append",
        timeMode="None",
    )


def fenced_rows(writes: DataFrame, stored: DataFrame, key: str, fence: str, order: str, block: Column) -> DataFrame:
    """Mark a write accepted when its fence is not below any earlier one of its key, in the store or in the batch.

    ``stored`` has the highest accepted fence per key.
    """
    seen = with_running(writes, F.col(fence), "_top", [key], [order], block, "max", include_current=False)
    held = stored.select(key, F.col(fence).alias("_held"))
    limit = F.greatest("_top", "_held")
    return seen.join(held, key, "left").withColumn("accepted", limit.isNull() | (F.col(fence) >= limit)).drop("_top", "_held")


def stream_fenced_rows(writes: DataFrame, key: str, fence: str, order: str) -> DataFrame:
    """The same on a stream, by the columns ``(key, order, fence)``: state per key is its highest fence so far.

    Writes of a key in one micro-batch are taken by ``order``; a source's limit for each trigger bounds how many these are.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    names = [key, order, fence]
    kinds = dict(writes.dtypes)

    class Fences(StatefulProcessor):
        def init(self, handle):
            self.top = handle.getValueState("top", "fence bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            held = [(frame[order].to_numpy(), frame[fence].to_numpy()) for frame in rows]
            at, fences = (np.concatenate(x) for x in zip(*held))
            by_order = np.argsort(at, kind="stable")
            at, fences = at[by_order], fences[by_order]
            first = self.top.get()[0] if self.top.exists() else fences[0]
            limit = np.maximum.accumulate(np.concatenate([[first], fences]))
            self.top.update((int(limit[-1]),))
            yield pd.DataFrame({names[0]: key[0], names[1]: at, names[2]: fences, "accepted": fences >= limit[:-1]})

        def close(self):
            pass

    return writes.select(*names).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Fences(),
        outputStructType=", ".join(f"`{n}` {kinds[n]}" for n in names) + ", accepted boolean",
        outputMode="append",
        timeMode="None",
    )


def fenced_upsert(writes: DataFrame, path: str, key: str, fence: str, order: str, checkpoint: str) -> None:
    """Apply a stream of fenced writes to an append-only store; refused writes go to an error table.

    The highest fence of each key is in the state store, so a micro-batch writes its own rows and no more. Needs :class:`RocksDB`.
    """

    def each(marked: DataFrame, batch_id: int) -> None:
        marked.write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/batch={batch_id}")

    run_batches(stream_fenced_rows(writes, key, fence, order), each, "fenced", checkpoint)


def fenced_store(spark: SparkSession, path: str) -> DataFrame:
    """The accepted and the refused writes of :func:`fenced_upsert`; a filter on ``accepted`` opens the files of one kind only."""
    return spark.read.parquet(path).withColumn("accepted", F.col("accepted").cast("boolean"))


def snapshot_plus_watch(
    changes: DataFrame,
    log: str,
    member: str,
    kind: str,
    after_batch: Callable[[DataFrame], DataFrame],
    checkpoint: str | None = None,
) -> None:
    """Follow full lists and changes of members: every micro-batch appends a row for each member that it names.

    ``kind`` is ``list``, ``add`` or ``remove``; a list replaces all members, then the batch's adds and removes apply.
    :func:`listed_members` of the log gives the members; what a batch writes follows the batch, not the number of members.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        named = after_batch(batch).where(F.col(kind).isin("list", "add", "remove")).groupBy(member)
        last = named.agg(F.bool_or(F.col(kind) == "list").alias("listed"), (~F.bool_or(F.col(kind) == "remove")).alias("present"))
        last.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    run_batches(changes, each, "snapshot", checkpoint)


def listed_members(spark: SparkSession, log: str, member: str) -> DataFrame:
    """The members after all micro-batches: the last word on each since the newest full list."""
    rows = spark.read.parquet(log)
    newest = rows.agg(F.coalesce(F.max(F.when(F.col("listed"), F.col("batch"))), F.lit(0))).scalar()
    last = rows.where(F.col("batch") >= newest).groupBy(member).agg(F.max_by("present", "batch").alias("present"))
    return last.where("present").select(member)


def stream_dedup(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first report of each key, however late it or its repeats come. State is one key per report that was kept."""
    return reports.dropDuplicates(list(keys))


def user_state(events: DataFrame, key: str, start: dict, adjust: Callable[[dict, "pd.DataFrame"], dict]) -> DataFrame:  # noqa: F821
    """State of any shape per key, kept as JSON text; ``adjust`` turns the old state and new rows into the new one."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    key_name = key

    class UserState(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("state", "body string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            import json

            body = json.loads(self.state.get()[0]) if self.state.exists() else dict(start)
            for frame in rows:
                body = adjust(body, frame)
            text = json.dumps(body, sort_keys=True)
            self.state.update((text,))
            yield pd.DataFrame({key_name: [key[0]], "state": [text]})

        def close(self):
            pass

    return events.groupBy(key).transformWithStateInPandas(
        statefulProcessor=UserState(), outputStructType=f"{key} bigint, state string", outputMode="update", timeMode="None"
    )
