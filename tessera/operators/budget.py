"""Running sums in two passes, so that one hot group is many tasks: totals of blocks, their offsets, and sums within blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_before(rows: DataFrame, group: str, order: str, value: str, into: str, block: int = 1024, budget: int | None = None) -> DataFrame:
    """`rows` with `into`: the sum of `value` (null counts as 0) over the rows of the same group with a smaller `order`, an integer; rows without group or order are left out.

    A block holds the orders from b * block to (b + 1) * block; only its totals meet those of the whole group. With a `budget`, blocks that begin at or beyond it are not read
    on, and rows at or beyond it go. Rows with one order come one after the other, in no stated order.
    """
    at, offset = f"{into}_block", f"{into}_offset"
    placed = rows.filter(F.col(group).isNotNull() & F.col(order).isNotNull()).withColumn(at, F.floor(F.col(order) / block).cast("long"))
    totals = placed.groupBy(group, at).agg(F.sum(F.coalesce(value, F.lit(0))).alias(offset))
    ahead = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(offset, F.coalesce(F.sum(offset).over(ahead), F.lit(0)))
    if budget is not None:
        totals = totals.filter(F.col(offset) < budget)
    inside = Window.partitionBy(group, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(inside), F.lit(0))
    out = placed.join(totals, [group, at]).withColumn(into, F.col(offset) + local).select(*rows.columns, into)
    return out if budget is None else out.filter(F.col(into) < budget)


def lists(rows: DataFrame, group: str, order: str, fields: list[str], most: int = 1000) -> DataFrame:
    """(group, part, members): the rows of each group by `order` (an integer, once per group), as lists of at most `most` structs of order and `fields`, numbered from 0.

    Places in a group come from running sums, so neither a row nor a task holds a whole group. Rows without group or order are left out.
    """
    at = "place_" + "_".join([group, order, *fields])
    placed = running_before(rows.select(group, order, *fields).withColumn(f"{at}_one", F.lit(1)), group, order, f"{at}_one", at)
    members = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return placed.groupBy(group, F.floor(F.col(at) / most).cast("long").alias("part")).agg(members.alias("members"))
