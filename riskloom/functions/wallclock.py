"""Wall-clock (TIMESTAMP_NTZ) literals, formatting and parsing that never touch the session zone.

``date_format`` and ``to_timestamp`` go through the session time zone: a
wall-clock time inside a daylight-saving gap of that zone (02:30 on a
spring-forward night) is shifted, and a Python ``datetime`` literal becomes
an instant.  Incident times are wall-clock values of the sheet's region, so
they are built, printed and parsed from their fields instead.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz_lit(value: dt.datetime | dt.date | None) -> Column:
    """A TIMESTAMP_NTZ (or DATE) literal from a naive Python value, independent of any zone."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value.isoformat()).cast("date")


def pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def year4(c: Column) -> Column:
    # lpad truncates longer strings, so years outside 0..9999 take the slower exact format.
    return F.when(c.between(0, 9999), F.lpad(c.cast("string"), 4, "0")).otherwise(F.format_string("%04d", c))


def fmt_day_first(x, with_time: bool = True, seconds: bool = False) -> Column:
    """'dd.MM.yyyy', 'dd.MM.yyyy HH:mm' or 'dd.MM.yyyy HH:mm:ss' from the value's fields; null stays null.

    Built from lpad/concat (generated code) rather than format_string, which
    calls java.lang.String.format per row.
    """
    x = _c(x)
    parts = [pad2(F.dayofmonth(x)), F.lit("."), pad2(F.month(x)), F.lit("."), year4(F.year(x))]
    if with_time:
        parts += [F.lit(" "), pad2(F.hour(x)), F.lit(":"), pad2(F.minute(x))]
        if seconds:
            parts += [F.lit(":"), pad2(F.second(x))]
    return F.when(x.isNotNull(), F.concat(*parts))


_DAY_FIRST = r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?)?\s*$"
_ISO = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?)?\s*$"


def _from_groups(s: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    def g(i):
        return F.regexp_extract(s, pattern, i)
    matched = s.rlike(pattern)
    y, m, d = (g(i).try_cast("int") for i in order)
    h = F.coalesce(F.nullif(g(4), F.lit("")).try_cast("int"), F.lit(0))
    mi = F.coalesce(F.nullif(g(5), F.lit("")).try_cast("int"), F.lit(0))
    sec = F.coalesce(F.nullif(g(6), F.lit("")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    return F.when(matched, F.try_make_timestamp_ntz(y, m, d, h, mi, sec))


def parse_wallclock(x) -> Column:
    """Day-first ('dd.MM.yyyy[ HH:mm[:ss]]') or ISO text → TIMESTAMP_NTZ; anything else → null."""
    s = _c(x).cast("string")
    return F.coalesce(_from_groups(s, _DAY_FIRST, (3, 2, 1)), _from_groups(s, _ISO, (1, 2, 3)))
