"""Scoring samples with teacher models, batch by batch, in Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from batchloom.operators import batching
from batchloom.operators.positions import id_positions

# A teacher maps {feed name: array [batch, ...]} to {fetch name: array [batch, ...]}.
Teacher = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def linear_teacher(classes: int, dim: int, salt: int = 0, feed: str = "img", fetch: str = "prediction") -> Callable[[], Teacher]:
    """Opens a linear model whose weights follow from the indices, so that SQL can compute it too."""

    def open_teacher():
        import numpy as np

        c, d = np.arange(classes)[:, None], np.arange(dim)[None, :]
        weights = ((c * 31 + d * 17 + salt * 7) % 13 - 6) / 10.0
        return lambda feeds: {fetch: feeds[feed].astype("f8") @ weights.T}

    return open_teacher


def output_schema(df: DataFrame, fetches: dict[str, str], more: Sequence[tuple[str, str]] = ()) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join(kept + [f"`{n}` {t}" for n, t in [*fetches.items(), *more]])


def as_array(column: pa.Array) -> np.ndarray:
    """A column as an array, lists as further dimensions; all lists of a level must have one length."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) != 1 or sizes[0] is None:
        raise ValueError(f"lists of lengths {sizes} in one batch")
    inner = as_array(column.flatten())
    return inner.reshape(len(column), sizes[0], *inner.shape[1:])


def as_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The reverse of :func:`as_array`."""
    if values.ndim == 1:
        return pa.array(values).cast(kind)
    inner = as_column(values.reshape(-1, *values.shape[2:]), kind.value_type)
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, inner)


def score_with_teacher(
    df: DataFrame,
    open_teacher: Callable[[], Teacher],
    feeds: dict[str, str],
    fetches: dict[str, str],
    batch_size: int,
    together: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the fetched columns to the columns ``keep`` of every row, by default all columns.

    The model is opened once per task. Arrow batches are re-cut, so the teacher sees exactly
    ``batch_size`` rows at a time; with ``together`` it sees runs of equal values of that column instead,
    by which the rows must be partitioned and sorted. ``feeds`` maps feed names to columns, ``fetches``
    fetch names to types. Only the kept and the fed columns are read, only the kept ones and the answers come back.
    """
    kept = list(df.columns if keep is None else keep)
    fed = [*feeds.values(), *([together] if together else [])]
    sent = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, *fed])])
    schema = output_schema(sent.select(*[f"`{c}`" for c in kept]), fetches)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teacher, held = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            teacher = teacher or open_teacher()
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ends = cuts(held)
            if ends:
                yield from answer(teacher, held.slice(0, ends[-1]), ends)
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield from answer(teacher, held, [held.num_rows])

    def cuts(rows: pa.Table) -> list[int]:
        """Ends of the batches that are known to be complete."""
        if together is None:
            return list(range(batch_size, rows.num_rows + 1, batch_size))
        keys = rows[together].to_numpy()
        return (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()

    def answer(teacher: Teacher, rows: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        arrays = {name: as_array(pa.concat_arrays(rows[column].chunks)) for name, column in feeds.items()}
        parts = [teacher({name: x[start:end] for name, x in arrays.items()}) for start, end in zip([0, *ends], ends)]
        columns = [rows[c].cast(kinds.field(c).type) if pa.types.is_nested(rows[c].type) else rows[c] for c in kept]
        columns += [as_column(np.concatenate([part[name] for part in parts]), kinds.field(name).type) for name in fetches]
        yield from pa.table(columns, names=[*kept, *fetches]).combine_chunks().to_batches()

    return sent.mapInArrow(score, schema)


def score_or_dead_letter(
    df: DataFrame, open_teacher: Callable[[], Teacher], feeds: dict[str, str], fetches: dict[str, str], batch_size: int, attempts: int = 3
) -> DataFrame:
    """Score with retries: a batch gets ``attempts`` tries, then its rows are tried one by one.

    Adds ``attempts`` and ``error``; a row with an error goes to the dead letters, no row is lost. Answers of another number than the rows
    are an error, and so are fed lists that are null, or of unlike lengths in one batch; tried one by one the latter are answered.
    """

    schema = output_schema(df, fetches, [("attempts", "int"), ("error", "string")])
    kinds, columns = to_arrow_schema(StructType.fromDDL(schema)), list(df.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teacher = None

        def settle(rows: pa.RecordBatch) -> tuple[list[pa.Array] | None, int, str | None]:
            error = None
            for n in range(1, attempts + 1):
                try:
                    fetched = teacher({name: as_array(rows[column]) for name, column in feeds.items()})
                    answers = [as_column(np.asarray(fetched[name]), kinds.field(name).type) for name in fetches]
                    if any(len(x) != rows.num_rows for x in answers):
                        raise ValueError(f"{[len(x) for x in answers]} answers for {rows.num_rows} rows")
                    return answers, n, None
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
            return None, attempts, error

        def told(rows: pa.RecordBatch, answers: list[pa.Array] | None, used: int, error: str | None) -> pa.RecordBatch:
            n = rows.num_rows
            fetched = answers or [pa.nulls(n, kinds.field(name).type) for name in fetches]
            kept = [rows[c].cast(kinds.field(c).type) for c in columns]
            last = [pa.array([used] * n, pa.int32()), pa.array([error] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*kept, *fetched, *last], schema=kinds)

        for batch in batches:
            teacher = teacher or open_teacher()
            for at in range(0, batch.num_rows, batch_size):
                rows = batch.slice(at, batch_size)
                outcome = settle(rows)
                if outcome[2] is None or rows.num_rows == 1:
                    yield told(rows, *outcome)
                else:
                    single = [rows.slice(i, 1) for i in range(rows.num_rows)]
                    yield from (told(row, *settle(row)) for row in single)

    return df.mapInArrow(score, schema)


def open_several(teachers: dict[str, Callable[[], Teacher]], fetch: str) -> Callable[[], Teacher]:
    """One teacher that asks several; what each answers as ``fetch`` gets its name."""

    def open_all():
        models = {name: open_teacher() for name, open_teacher in teachers.items()}
        return lambda feeds: {name: model(feeds)[fetch] for name, model in models.items()}

    return open_all


def ensemble_teachers(
    df: DataFrame, teachers: Sequence[tuple[Callable[[], Teacher], float]], feeds: dict[str, str], fetch: str, batch_size: int,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Weighted mean of the teachers' answers, element by element; all teachers answer in one pass."""
    names = [f"_t{n}" for n in range(len(teachers))]
    asked = open_several({name: open_teacher for name, (open_teacher, _) in zip(names, teachers)}, fetch)
    scored = score_with_teacher(df, asked, feeds, dict.fromkeys(names, "array<double>"), batch_size, keep=keep)
    scale = sum(w for _, w in teachers)

    def share(name, weight):
        return F.transform(name, lambda x: x * (weight / scale))

    weighted = [share(n, w) for n, (_, w) in zip(names, teachers)]
    return scored.withColumn(fetch, reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), weighted)).drop(*names)


def audit_counts(fed: DataFrame, predicted: DataFrame, task: str) -> DataFrame:
    """Rows fed and rows predicted per task."""
    left = fed.groupBy(task).agg(F.count(F.lit(1)).alias("feed_count"))
    right = predicted.groupBy(task).agg(F.count(F.lit(1)).alias("predict_count"))
    counts = left.join(right, task, "full").na.fill(0, ["feed_count", "predict_count"])
    return counts.withColumn("matches", F.col("feed_count") == F.col("predict_count"))


def audited_write(fed: DataFrame, score: Callable[[DataFrame], DataFrame], path: str) -> dict[str, int | bool]:
    """Write ``score(fed)`` to ``path`` and tell how many rows went into it and came out of it.

    Both counts are observed while the one job runs, so nothing is read twice and nothing is joined. They are sums over all tasks; :func:`audit_counts`
    tells which task lost a row. The file is there only if the job ended, and so are the counts.
    """
    before, after = Observation(), Observation()
    scored = score(fed.observe(before, F.count(F.lit(1)).alias("n"))).observe(after, F.count(F.lit(1)).alias("n"))
    scored.write.parquet(path)
    counts = {"feed_count": before.get["n"], "predict_count": after.get["n"]}
    return counts | {"matches": counts["feed_count"] == counts["predict_count"]}


def map_records(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a mapper of frames to the records, in parallel and in no order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield mapper(frame)

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class Distillation:
    """Samples in, samples with teacher predictions out, in input order and input form.

    ``feeds`` maps the teacher's feed names to columns, ``predicts`` its fetch names to types.
    """

    feeds: dict[str, str]
    predicts: dict[str, str]
    teacher: Callable[[], Teacher] | None = None
    batch_size: int = 16
    source: DataFrame | None = None
    form: str = "sample"
    keys: tuple[str, ...] = field(default=())

    def with_teacher(self, open_teacher: Callable[[], Teacher]) -> Distillation:
        return replace(self, teacher=open_teacher)

    def with_teacher_batch_size(self, size: int) -> Distillation:
        return replace(self, batch_size=size)

    def samples(self, df: DataFrame, id_col: str) -> Distillation:
        """One sample per row, in the order of a unique integer."""
        return replace(self, source=df, form="sample", keys=(id_col,))

    def sample_lists(self, df: DataFrame, list_id: str, item: str) -> Distillation:
        """Samples of user lists; teacher batches never span two lists."""
        return replace(self, source=df, form="list", keys=(list_id, item))

    def columnar_batches(self, df: DataFrame, batch_id: str, slots: Sequence[str]) -> Distillation:
        """One row per batch with an array per slot."""
        return replace(self, source=df, form="columnar", keys=(batch_id, *slots))

    def tasks(self) -> DataFrame:
        """The samples with ``task_id`` and ``place``."""
        if self.form == "sample":
            return batching.number_tasks(id_positions(self.source, self.keys[0]), "pos", self.batch_size)
        if self.form == "list":
            return batching.rebatch_lists(self.source, *self.keys, self.batch_size)
        rows = batching.explode_columnar(self.source, self.keys[1:])
        return batching.rebatch_lists(rows, self.keys[0], "item", self.batch_size)

    def scored(self) -> DataFrame:
        """Scored rows; the teacher sees the numbered tasks, one by one."""
        placed = self.tasks().repartition("task_id").sortWithinPartitions("task_id", "place")
        return score_with_teacher(placed, self.teacher, self.feeds, self.predicts, self.batch_size, "task_id")

    def run(self) -> DataFrame:
        """Samples in input order, or lists and columnar batches with their predictions."""
        if self.form == "sample":
            return batching.restore_order(self.scored().drop("task_id", "place"), ["pos"])
        columns = [c for c in self.source.columns if c != self.keys[0]] if self.form == "list" else list(self.keys[1:])
        lists = batching.regroup_lists(self.scored(), self.keys[0], "pos", "list_size", [*columns, *self.predicts])
        return lists if self.form == "list" else batching.to_columnar(lists, "rows", [*columns, *self.predicts])


def fit_linear(df: DataFrame, features: Sequence[str], target: str):
    """Least squares fit; the normal equations are summed over the cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(labelCol=target, solver="normal")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model]).fit(df)


def fit_softmax(df: DataFrame, vector: str, label: str, iterations: int = 50):
    """Softmax regression with cross-entropy on an array column."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias(label))
    return LogisticRegression(labelCol=label, family="multinomial", maxIter=iterations).fit(rows)
