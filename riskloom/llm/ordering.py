"""Positions in a global order, without gathering the rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: partition number above, place in the partition below


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``, their 0-based place (long) in ``order``.

    The rows are range-partitioned by ``order`` and sorted inside the partitions.  The table with the places
    is written before the partitions are counted, so a task that runs again cannot change them.  One count for
    each partition passes the driver.  Rows that ``order`` cannot tell apart get places of their own, any way.
    """
    spark = rows.sparkSession
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("__at", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))
    starts = [0, *accumulate(n for _, n in sizes)]
    before = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "__part long, __before long")
    return placed.join(F.broadcast(before), part == F.col("__part")).withColumn(
        name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_IN_PARTITION))).drop("__at", "__part", "__before")
