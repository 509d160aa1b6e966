"""Typed, lenient and parsing casts.

ANSI mode is on in Spark 4, so every coercion the reference does leniently is
written with ``try_*`` functions; strict casts stay plain ``cast`` and fail on
bad input, as the reference's ``astype`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.wallclock import parse_wallclock



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_cast(x, dtype: str) -> Column:                  # S07
    return _c(x).cast(dtype)


def lenient_int(x, default: int = 0) -> Column:            # S08: 'abc'->0, '12.7'->12, ' 7 '->7
    as_double = _c(x).cast("string").try_cast("double")
    return F.coalesce(as_double.try_cast("bigint"), F.lit(default).cast("bigint"))


def key_before_dot(x) -> Column:                           # S09: '12.0' -> 12
    return F.substring_index(_c(x).cast("string"), ".", 1).cast("int")


def sheet_id(x) -> Column:
    """An id cell by the same rule, null where it is not a number."""
    return F.substring_index(F.trim(_c(x).cast("string")), ".", 1).try_cast("int")


def sheet_int(x) -> Column:
    """A whole number from a sheet cell: '3.0' is 3, '12.7' is 12, an empty cell is null, other text is an error."""
    cell = F.trim(_c(x).cast("string"))
    whole = cell.try_cast("double").try_cast("bigint").try_cast("int")
    return F.when(cell.isNull() | (cell == ""), F.lit(None).cast("int")).when(whole.isNotNull(), whole).otherwise(
        F.raise_error(F.concat(F.lit("not a number in a sheet: "), cell)).cast("int"))


def parse_dayfirst(x) -> Column:                           # S10: bad -> null
    """Day-first text (or ISO) to a wall-clock timestamp, built from its fields (zone-free)."""
    return parse_wallclock(x)


def naive_utc(x) -> Column:                                # S12: zone-aware -> naive UTC wall clock
    return F.convert_timezone(None, F.lit("UTC"), _c(x).cast("timestamp_ntz"))


def parse_date(x) -> Column:                               # S13
    return parse_wallclock(x).cast("date")


def truthy(x, null_as: bool = True) -> Column:              # P19 / D8: bool(NaN) is True
    return F.coalesce(_c(x).try_cast("double") != 0, F.lit(null_as))


def default_zero(x) -> Column:                             # P20: empty -> 0, '5.0' -> 5
    return F.coalesce(sheet_int(x), F.lit(0))


def clean_number(x) -> Column:                             # P22: null, NaN, ±inf -> 0
    d = _c(x).cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(d)
