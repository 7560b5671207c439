"""Membership as sets of rows: differences, deltas, classes, deduplication, change folding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tagged(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(tag, F.lit(True))


def membership_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every member with ``added``, ``removed`` or ``kept``."""
    both = _tagged(old, keys, "_old").join(_tagged(new, keys, "_new"), list(keys), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return both.select(*keys, change.alias("change"))


def apply_membership_delta(servers: DataFrame, added: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(servers + added) - removed``."""
    keys = list(keys)
    return servers.select(keys).unionByName(added.select(keys)).distinct().join(removed.select(keys), keys, "left_anti")


def member_classes(current: DataFrame, resource: DataFrame, statuses: DataFrame, member: str, status: str) -> DataFrame:
    """Class of each current member: its status, else ``alive`` when it has a resource, else ``disappeared``.

    ``statuses`` has one row per member.
    """
    joined = (
        current.select(member).distinct()
        .join(statuses.select(member, F.col(status).alias("_s")), member, "left")
        .join(_tagged(resource, [member], "_r"), member, "left")
    )
    name = F.when(F.col("_s").isNotNull(), F.col("_s")).when(F.col("_r"), "alive").otherwise("disappeared")
    return joined.select(member, name.alias("class"))


def sets_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: are the sets equal, and how many members are on one side only."""
    both = _tagged(left, keys, "_l").join(_tagged(right, keys, "_r"), list(keys), "full")
    only_left, only_right = F.count_if(F.col("_r").isNull()), F.count_if(F.col("_l").isNull())
    return both.agg(
        ((only_left + only_right) == 0).alias("equal"), only_left.alias("only_left"), only_right.alias("only_right")
    )


def dedup_batches(reports: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The first report of each batch; partial aggregation keeps one row per key before the shuffle."""
    rest = [c for c in reports.columns if c not in keys]
    first = reports.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("_f"))
    return first.select(*keys, *[F.col("_f")[c].alias(c) for c in rest])


def fold_changes(changes: DataFrame, keys: Sequence[str], op: Column, value: str, revision: str) -> DataFrame:
    """The last put or delete per key: ``op`` is ``add`` or ``remove``, with the value and its revision."""
    last = changes.groupBy(*keys).agg(
        F.max_by(F.struct(op.alias("op"), F.col(value).alias("value"), F.col(revision).alias("revision")), F.col(revision)).alias("_l")
    )
    return last.select(*keys, "_l.op", F.when(F.col("_l.op") == "add", F.col("_l.value")).alias("value"), "_l.revision")
