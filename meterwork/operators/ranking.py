"""Places in a sorted table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# A row's number holds its partition above this bit and its place in the partition below it.
_BITS = 33


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the row's place (from 1) in ``order`` and give the rows in that order.

    Rows are dealt by ranges of the order and numbered inside their range; the rows of all ranges before it, one
    count per task, are added. No task sees more than its range. ``order`` should leave no ties.
    """
    at = F.monotonically_increasing_id()
    dealt = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    part, offset, held = F.shiftright("_at", _BITS), 0, []
    for row in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():  # as many as there are tasks
        held += [F.lit(row["part"]), F.lit(offset)]
        offset += row["count"]
    before = F.element_at(F.create_map(*held), part) if held else F.lit(0)
    place = (before + F.col("_at").bitwiseAND((1 << _BITS) - 1) + 1).cast("int")
    return dealt.withColumn(name, place).drop("_at").orderBy(name)


def with_sum_before(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value``, a whole number, over the rows that come earlier in ``order``, dealt as in ``with_rank``."""
    part = F.shiftright("_at", _BITS)
    dealt = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_value", value), "summed")
    held, total = [], 0
    for row in dealt.groupBy(part.alias("part")).agg(F.sum("_value").alias("value")).orderBy("part").collect():  # as many as there are tasks
        held += [F.lit(row["part"]), F.lit(total).cast("bigint")]
        total += row["value"]
    ahead = F.element_at(F.create_map(*held), part) if held else F.lit(0)
    earlier = F.sum("_value").over(Window.partitionBy(part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(name, ahead + F.coalesce(earlier, F.lit(0))).drop("_at", "_value")
