"""Running totals and carried values inside groups, without a task for each group.

A window ordered over a whole group sorts it in one task. Here rows are cut into ranges of (group,
order), each range is summed up by itself, and what lies before it in its group is added from the
sums of the ranges, of which there are as many as tasks; so a group may span any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.plans.staging import Workspace

_COMBINE = {"sum": F.sum, "max": F.max}


def running(rows: DataFrame, group: str, order: list[str], value: str, how: str, out: str) -> DataFrame:
    """Adds ``out``: the sum or maximum of ``value`` over the rows of the group up to this one in ``order``.

    Orders must be unique within a group where it matters; nulls in ``value`` count for nothing.
    """
    combine = _COMBINE[how]
    work = Workspace(rows.sparkSession, "running")
    placed = work.save(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(F.col(group).alias("_group"), "_range").agg(combine(value).alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", F.col("_range").alias("_at"), combine("_sum").over(before).alias("_before"))
    joined = placed.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    inside = combine(value).over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if how == "sum":
        total = F.coalesce(inside, F.lit(0)) + F.coalesce("_before", F.lit(0))
    else:
        total = F.greatest(inside, "_before")
    return joined.select(*rows.columns, total.alias(out))
