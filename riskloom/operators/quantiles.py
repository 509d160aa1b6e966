"""Exact quantiles and running counts by distributed selection.

Equal values of a group are counted first (combined inside each task), the distinct values are
range-partitioned by (group, value), and the counts of the partitions before a value's own, one number for
each partition and group, turn its place in its partition into its place in the group.  The rows that hold
the wanted places are then picked by a filter.  No group and no set of values is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import reliable_checkpoint


def running_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(*by, value, n, upto, total): each distinct non-null value of a group, its rows, those at or below it, and all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    group = F.struct(*by) if by else F.lit(0)                 # a struct, so a null group meets itself in the join
    parted = reliable_checkpoint(counts.repartitionByRange(*by, value).withColumn("_pid", F.spark_partition_id())
                                 .withColumn("_group", group))
    sums = parted.groupBy("_group", "_pid").agg(F.sum("n").alias("_held"))
    whole = Window.partitionBy("_group")                      # one row for each partition that holds the group
    before = sums.withColumns({"_before": F.sum("_held").over(whole.orderBy("_pid")) - F.col("_held"),
                               "total": F.sum("_held").over(whole)}).drop("_held")
    inside = F.sum("n").over(Window.partitionBy("_group", "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("_inside", inside).join(before, ["_group", "_pid"]).select(
        *by, value, "n", (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def exact_quantile(df: DataFrame, value: str, q: float, by: str | list[str] | None = None, out: str = "quantile") -> DataFrame:
    """The linearly interpolated ``q`` quantile of a numeric column, per group if ``by`` is given.

    Nulls do not count; a group without any other value has a null quantile.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    counts = running_counts(df.select(*by, F.col(value).cast("double").alias("_v")), "_v", by)
    place = F.lit(float(q)) * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)

    def holds(at: Column) -> Column:
        return (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))

    picked = counts.where(holds(low) | holds(high)).groupBy(*by).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"),
        F.max(place - low).alias("_part"))
    found = picked.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out))
    if not by:
        return found
    groups = df.select(*by).distinct()
    same = [groups[c].eqNullSafe(found[c]) for c in by]
    return groups.join(found, same, "left").select(*[groups[c] for c in by], out)


def cut_points(df: DataFrame, value: str, by: str, most: int) -> DataFrame:
    """(by, value): at most ``most`` values of each group that part its rows evenly; all distinct values if they are few enough."""
    counts = running_counts(df, value, [by])
    few = counts.groupBy(by).agg((F.count(F.lit(1)) <= most).alias("_few"))
    step = F.floor(F.col("upto") * most / F.col("total")) > F.floor((F.col("upto") - F.col("n")) * most / F.col("total"))
    return counts.join(F.broadcast(few), by).where(F.col("_few") | step).select(by, value)
