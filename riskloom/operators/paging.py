"""Whole orders and pages of them without an offset.

An order is a list of (column, descending).  It is made total by the other columns of the frame, so
only rows that are equal in every column tie, and those cannot be told apart.  Nulls come first
when ascending and last when descending.

``with_position`` ranks *all* rows: they are range-partitioned by the order, the sorted partitions are
written to the shared checkpoint folder, and a row's position is the number of rows in the
partitions before its own plus its place inside it.  One count for each partition passes the driver.

``page_after`` needs no rank at all: a cursor holds the last row shown and how many rows equal to it
have been shown, and the next page is a filter and a top-k (each task keeps ``size`` rows).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import reliable_checkpoint

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: partition number above, place in the partition below


def total_order(df: DataFrame, order) -> list[tuple[str, bool]]:
    """``order`` and, ascending, the columns of ``df`` that it does not name."""
    named = {c for c, _ in order}
    return [*order, *((c, False) for c in df.columns if c not in named)]


def sort_columns(order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def with_position(df: DataFrame, order, name: str = "position") -> DataFrame:
    """``df`` with ``name``, the 1-based place (long) of each row in the total order."""
    keys = sort_columns(total_order(df, order))
    # The last key spreads copies of one row over several ranges.
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    placed = reliable_checkpoint(salted.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys, "_salt")
                                 .drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))
    starts = [0, *accumulate(n for _, n in sizes)]
    before = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _before long")
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)) + 1
    return placed.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, at.alias(name))


@dataclass(frozen=True)
class Cursor:
    """The last row shown, by column, and how many rows equal to it have been shown."""

    last: Row
    seen: int


def cursor_after(page: list[Row], before: Cursor | None = None) -> Cursor | None:
    """The cursor behind a page (a list of at most ``size`` rows); an empty page leaves it where it was."""
    if not page:
        return before
    same = sum(r == page[-1] for r in page)
    return Cursor(page[-1], same + (before.seen if before and before.last == page[-1] else 0))


def _literals(df: DataFrame, row: Row) -> dict[str, Column]:
    """The row's values as literals of the column types."""
    def lit(value, kind: T.DataType) -> Column:
        return F.lit(None).cast(kind) if value is None else F.lit(value).cast(kind)
    return {f.name: lit(row[f.name], f.dataType) for f in df.schema.fields}


def beyond(df: DataFrame, order, row: Row) -> tuple[Column, Column]:
    """(rows after ``row`` in the total order, rows equal to it) as conditions."""
    later, equal, values = F.lit(False), F.lit(True), _literals(df, row)
    for c, down in total_order(df, order):
        x, y = F.col(c), values[c]
        further = (x < y) | (x.isNull() & y.isNotNull()) if down else (x > y) | (x.isNotNull() & y.isNull())
        later, equal = later | (equal & F.coalesce(further, F.lit(False))), equal & x.eqNullSafe(y)
    return later, equal


def page_after(df: DataFrame, order, size: int, cursor: Cursor | None = None) -> DataFrame:
    """The next ``size`` rows of the total order, in that order; the first ones without a cursor."""
    keys = sort_columns(total_order(df, order))
    if cursor is None:
        return df.orderBy(*keys).limit(size)
    later, equal = beyond(df, order, cursor.last)
    copies = min(size, max(0, df.where(equal).count() - cursor.seen))
    rest = df.where(later).orderBy(*keys).limit(size - copies)
    if not copies:
        return rest
    again = df.sparkSession.range(copies).select(*[v.alias(c) for c, v in _literals(df, cursor.last).items()])
    return again.unionByName(rest).orderBy(*keys)
