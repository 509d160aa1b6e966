"""Filters and predicates F01–F14.

All are Column predicates on the scan side of the plan, so Catalyst pushes
equality / IN / range predicates on stored columns into the Parquet reader
(``PushedFilters``) and prunes row groups by their statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K


def multi_select(df: DataFrame, col: str, values) -> DataFrame:                 # F01, F02
    values = list(values or [])
    return df.where(F.col(col).isin(values)) if values else df


def success_filter(df: DataFrame, mode: str = "all", label: str = "success") -> DataFrame:   # F03
    if mode == "success":
        return df.where(F.col(label) == 1)
    if mode == "failure":
        return df.where(F.col(label) == 0)
    return df


def dashboard_filter(df: DataFrame, types=None, regions=None, mode: str = "all") -> DataFrame:
    return success_filter(multi_select(multi_select(df, "enterprise_type", types), "region", regions), mode)


def recent(df: DataFrame, as_of: Column, seconds: int = K.RECENT_SECONDS,
           time_col: str = "incident_time") -> DataFrame:                        # F04 / D20
    """Rows strictly newer than ``as_of - seconds``; no upper bound (future rows count)."""
    return df.where(F.col(time_col) > as_of - F.make_dt_interval(secs=F.lit(seconds)))


def facets(df: DataFrame, **equalities) -> DataFrame:                           # F06, F07
    conds = [F.col(c) == F.lit(v) for c, v in equalities.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def search(df: DataFrame, query: str, fields) -> DataFrame:                     # F08, F09
    """Admin search: every word of ``query`` must occur, case-insensitively, in some field."""
    words = [w for w in (query or "").split() if w]
    if not words:
        return df
    def field_has(w):
        return reduce(lambda a, b: a | b,
                      [F.coalesce(F.lower(F.col(f).cast("string")).contains(w.lower()), F.lit(False))
                       for f in fields])
    return df.where(reduce(lambda a, b: a & b, [field_has(w) for w in words]))


def date_drilldown(df: DataFrame, date_col: str = "incident_date", year: int | None = None,
                   month: int | None = None) -> DataFrame:                       # F10
    """Next level of the date hierarchy with row counts.

    No year → (year, n); a year → (month, n) within it; a year and month →
    (day, n).  Range predicates on the date column are pushed to the scan.
    """
    d = F.col(date_col)
    if year is None:
        return df.groupBy(F.year(d).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    lo = F.make_date(F.lit(year), F.lit(month or 1), F.lit(1))
    hi = F.add_months(lo, 1 if month else 12)
    rows = df.where((d >= lo) & (d < hi))
    if month is None:
        return rows.groupBy(F.month(d).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(F.dayofmonth(d).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def in_top_k(df: DataFrame, top: DataFrame, key: str) -> DataFrame:           # F11 / J02
    """Semi join on a top-k frame (k rows, bounded by construction → broadcast)."""
    return df.join(F.broadcast(top.select(key)), key, "left_semi")


def season_domain(df: DataFrame, col: str = "season_display") -> DataFrame:   # F12
    return df.where(F.col(col).isin(*K.SEASON_ORDER_DISPLAY))


def drop_null(df: DataFrame, *cols: str) -> DataFrame:                        # F13
    return df.dropna(subset=list(cols))


def guard(df: DataFrame, required) -> DataFrame:                              # F14
    """Empty result of the same schema when a required column is missing."""
    if all(c in df.columns for c in required):
        return df
    return df.limit(0)
