"""Top-k, arg-max, ordered listings and sampling.

``orderBy(...).limit(k)`` on an aggregate plans as ``TakeOrderedAndProject``:
each partition keeps its own k best rows and only those reach the final
merge, so a top-k never gathers a whole group anywhere.  Ties are broken by
the key (D5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.paging import sort_columns, total_order, with_position


def top_k_by_count(df: DataFrame, key: str, k: int = K.TOP_K, drop_null: bool = True) -> DataFrame:  # W04–W07
    src = df.where(F.col(key).isNotNull()) if drop_null else df                  # D4: value_counts drops nulls
    counts = src.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of ``df`` under ``order`` with a 1-based ``rank`` column.

    ``df`` is already small (an aggregate); the limit keeps only k rows before
    the window, so the single-partition window sees at most k rows.
    """
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def arg_max(df: DataFrame, key: str, measure: str) -> DataFrame:                # W08
    """Key with the greatest measure (smallest key on ties) and that measure: one row.

    ``orderBy().limit(1)`` is a TakeOrdered: one candidate per partition.
    """
    return df.orderBy(F.desc(measure), F.asc(key)).limit(1).select(key, measure)


def _page(df: DataFrame, size: int | None, number: int) -> DataFrame:
    """All rows, or page ``number`` (from 0) of ``size`` rows."""
    return df if size is None else df.offset(size * number).limit(size) if number else df.limit(size)


#: Newest first, ties by the other columns: (column, descending).
DEFAULT_ORDER = (("incident_date", True), ("incident_time", True), ("enterprise_code", False), ("threat_code", False),
                 ("host_count", False), ("success", False), ("region", False), ("enterprise_type", False))


def default_order(df: DataFrame, page: int | None = None, number: int = 0) -> DataFrame:                 # W10
    """Newest first (date desc, time desc), ties by all other columns: in full, or one page of it."""
    return _page(df.orderBy(*sort_columns(total_order(df, DEFAULT_ORDER))), page, number)


def default_order_after(df: DataFrame, first: DataFrame) -> DataFrame:                                   # W10
    """What comes after ``first``, the first rows of the default order of ``df``, in that order.

    An offset would gather all rows in one task; the rows are ranked over range partitions instead.
    """
    shown = first.count()
    ranked = with_position(df, DEFAULT_ORDER, "_position").where(F.col("_position") > shown)
    return ranked.orderBy("_position").drop("_position")


def order_by_column(df: DataFrame, col: str, descending: bool = False, page: int | None = None,
                    tie_break: tuple[str, ...] = (), number: int = 0) -> DataFrame:               # W11
    first = F.desc(col) if descending else F.asc(col)
    return _page(df.orderBy(first, *[F.asc(c) for c in tie_break if c != col]), page, number)


def latest(df: DataFrame, time_col: str = "incident_time", id_col: str = "incident_id") -> DataFrame:  # W12
    """The latest row (greatest time, then greatest id) as one row, via ``max_by``.

    ``max_by`` aggregates partially, so no sort or single-partition window.
    """
    cols = df.columns
    row = F.max_by(F.struct(*cols), F.struct(F.col(time_col), F.col(id_col)))
    return df.agg(row.alias("r")).where(F.col("r").isNotNull()).select("r.*")


def sample_one(df: DataFrame, seed: int, id_cols: list[str]) -> DataFrame:     # W13
    """One reproducible pseudo-random row: smallest md5(seed || '|' || id)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))
    return df.withColumn("_h", h).orderBy("_h", *id_cols).limit(1).drop("_h")
