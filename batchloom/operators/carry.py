"""Lag and running values per group where one group may hold a large share of the rows.

A plain window keeps a whole group in one task. Here the group is cut into blocks along its order,
each block is reduced to one row, the window runs over those rows, and its result is carried into
the block. Integer blocks are summed up level by level, so that no window holds more than 65,536 summaries,
however far apart the ids of a group are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DIGIT = 16  # bits of a block number that are told apart in one level


def id_block(column: str, width: int = 1 << 18) -> Column:
    """Block of an integer column."""
    return F.expr(f"`{column}` div {width}")


def over_earlier(blocks: DataFrame, group: Sequence[str], how: str = "sum", dense: bool = False) -> DataFrame:
    """``group, _block, _carry``: sum or max of ``_total`` over the earlier blocks of the group, null for its first.

    ``blocks`` has a row per group and block. Integer blocks have two levels of parents above them; each
    window runs among the children of one parent, and what is before the parent is added. Blocks of ``dense`` positions need
    no parents, as there is one for each 262,144 positions only.
    """
    aggregate = {"sum": F.sum, "max": F.max}[how]
    levels = [blocks]
    if not dense and dict(blocks.dtypes)["_block"] in ("int", "bigint"):
        for _ in range(2):
            parents = levels[-1].withColumn("_block", F.shiftright("_block", DIGIT))
            levels.append(parents.groupBy(*group, "_block").agg(aggregate("_total").alias("_total")))
    found = None
    for level in reversed(levels):
        if found is None:
            siblings = Window.partitionBy(*group)
        else:
            level = level.withColumn("_parent", F.shiftright("_block", DIGIT))
            siblings = Window.partitionBy(*group, "_parent")
        before = siblings.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        here = level.withColumn("_carry", aggregate("_total").over(before))
        if found is not None:
            above = found.select(*[F.col(g).alias(f"_a_{g}") for g in group], F.col("_block").alias("_above_block"), F.col("_carry").alias("_above"))
            match = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_a_{g}")) for g in group], F.col("_parent").eqNullSafe(F.col("_above_block")))
            both = F.coalesce(F.col("_carry") + F.col("_above"), "_carry", "_above") if how == "sum" else F.greatest("_carry", "_above")
            here = here.join(above, match, "left").withColumn("_carry", both)
        found = here.select(*group, "_block", "_carry")
    return found


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_carry")
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_c_{k}"]) for k in keys])
    return rows.join(renamed, match, "left").drop(*[f"_c_{k}" for k in keys])


def with_previous(
    df: DataFrame, values: dict[str, str], group: Sequence[str], order: Sequence[str], block: Column
) -> DataFrame:
    """Add the previous row's ``values`` (source column -> new name); null on the first row of a group."""
    rows = df.withColumn("_block", block)
    keys = [*group, "_block"]
    picked = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("at"), picked.alias("picked"))).alias("_total"))
    carry = over_earlier(last, group, "max").withColumn("_carry", F.col("_carry.picked"))
    inside = F.lag(picked).over(Window.partitionBy(*keys).orderBy(*order))
    joined = _join_carry(rows, carry, keys).withColumn("_prev", F.coalesce(inside, F.col("_carry")))
    return joined.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values.values()])


def with_running(
    df: DataFrame,
    value: Column,
    name: str,
    group: Sequence[str],
    order: Sequence[str],
    block: Column,
    how: str = "sum",
    include_current: bool = True,
    dense: bool = False,
) -> DataFrame:
    """Add the running ``sum`` or ``max`` of ``value`` along the order, with or without the current row.

    ``dense`` says that the blocks are those of positions without gaps.
    """
    aggregate = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_block", block).withColumn("_value", value)
    keys = [*group, "_block"]
    totals = rows.groupBy(*keys).agg(aggregate("_value").alias("_total"))
    carry = over_earlier(totals, group, how, dense)
    inside = aggregate("_value").over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    joined = _join_carry(rows, carry, keys).withColumn("_inside", inside)
    if how == "sum":
        total = F.coalesce(F.col("_inside"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        total = F.greatest("_inside", "_carry")
    return joined.withColumn(name, total).select(*df.columns, name)


def with_latest(
    points: DataFrame, marks: DataFrame, group: Sequence[str], at: str, payload: str, width: int = 1 << 18, dense: bool = False
) -> DataFrame:
    """As-of lookup: the ``payload`` struct of the last mark at or before each point, per group.

    Points and marks share the ``group`` and ``at`` columns; ``payload`` must grow with ``at`` inside a
    group. Points and marks meet on one ordered line that is cut into blocks, so there is no range join.
    """
    line = points.withColumn("_kind", F.lit(1)).unionByName(
        marks.select(*group, at, F.lit(0).alias("_kind"), F.col(payload).alias("_mark")), allowMissingColumns=True
    )
    found = with_running(line, F.col("_mark"), payload, group, [at, "_kind"], id_block(at, width), "max", dense=dense)
    return found.where(F.col("_kind") == 1).select(*points.columns, payload)
