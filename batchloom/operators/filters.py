"""Projections and filters on feeds, states, labels and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_feeds(df: DataFrame, keep: Sequence[str], feeds: dict[str, str]) -> DataFrame:
    """Only the columns the model feeds on (feed name -> column), as one struct next to the kept keys."""
    return df.select(*keep, F.struct(*[F.col(c).alias(name) for name, c in feeds.items()]).alias("feed"))


def append_predictions(df: DataFrame, prediction: str, predicts: Sequence[str]) -> DataFrame:
    """Input columns first, then the predictions in the asked order."""
    inputs = [c for c in df.columns if c != prediction]
    return df.select(*inputs, *[F.col(prediction)[p].alias(p) for p in predicts])


def effective_phase(phase: Column, deletion_time: Column) -> Column:
    """A pod with a deletion time is terminating, whatever its phase says."""
    return F.when(deletion_time.isNotNull(), "Terminating").otherwise(phase)


def filter_by_status(df: DataFrame, phase: Column, deletion_time: Column, wanted: str | None) -> DataFrame:
    marked = df.withColumn("phase", effective_phase(phase, deletion_time))
    return marked if wanted is None else marked.where(F.col("phase") == wanted)


def has_label_prefix(labels: Column, prefix: str) -> Column:
    """Some label key starts with the prefix."""
    return F.exists(F.map_keys(labels), lambda k: k.startswith(prefix))


def matches_labels(labels: Column, wanted: dict[str, str]) -> Column:
    """Number of labels that equal a wanted key and value."""
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in wanted.items()]
    return F.size(F.array_intersect(F.map_entries(labels), F.array(*pairs)))


def mask_padding(ids: Column, vectors: Column) -> Column:
    """Zero the vectors that belong to padding ids."""
    return F.zip_with(ids, vectors, lambda i, v: F.when(i != 0, v).otherwise(F.transform(v, lambda x: x * 0)))
