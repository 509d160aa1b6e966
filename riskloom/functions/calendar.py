"""Calendar and cyclic features (P01–P09, P12–P14) as Column expressions.

All are JVM-side expressions that stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour_of(t) -> Column:                       # P01
    return F.hour(_c(t))


def weekday_of(t) -> Column:                    # P02, Monday = 0
    return F.weekday(_c(t))


def month_of(t) -> Column:                      # P03
    return F.month(_c(t))


def season_of(m) -> Column:                     # P04; null and 9..11 fall to autumn
    m = _c(m)
    expr = None
    for label, months in K.SEASON_MONTHS.items():
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(K.SEASON_AUTUMN))


def with_calendar(df: DataFrame, time_col: str = "incident_time", fill_missing: bool = False) -> DataFrame:
    """Add hour, dow, month and season.

    ``fill_missing`` reproduces the scoring defaults (P05): a missing time gives
    hour 0, weekday 0 and month 1 (hence season winter).
    """
    h, d, m = hour_of(time_col), weekday_of(time_col), month_of(time_col)
    if fill_missing:
        h, d, m = F.coalesce(h, F.lit(0)), F.coalesce(d, F.lit(0)), F.coalesce(m, F.lit(1))
    return (df.withColumns({"hour": h, "dow": d, "month": m})
              .withColumn("season", season_of("month")))


def weekday_name(d) -> Column:                  # P06
    names = F.array(*[F.lit(x) for x in K.WEEKDAY_SHORT])
    d = _c(d)
    return F.when(d.between(0, 6), F.element_at(names, d + 1))


def is_weekend(d) -> Column:                    # P07
    return _c(d).isin(*K.WEEKEND_DAYS).cast("int")


def is_night(h) -> Column:                      # P08
    h = _c(h)
    return ((h >= K.NIGHT_FROM_HOUR) | (h <= K.NIGHT_TO_HOUR)).cast("int")


def is_working_hours(h) -> Column:              # P09
    return _c(h).between(K.WORK_FROM_HOUR, K.WORK_TO_HOUR).cast("int")


def cyclic(x, period: float, fn: str) -> Column:   # P12–P14
    angle = F.lit(2.0 * math.pi) * _c(x).cast("double") / F.lit(float(period))
    return F.sin(angle) if fn == "sin" else F.cos(angle)


def with_time_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_weekend": is_weekend("dow"),
        "night_attack": is_night("hour"),
        "working_hours": is_working_hours("hour"),
    })


def with_cyclic(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "hour_sin": cyclic("hour", 24, "sin"), "hour_cos": cyclic("hour", 24, "cos"),
        "dow_sin": cyclic("dow", 7, "sin"), "dow_cos": cyclic("dow", 7, "cos"),
        "month_sin": cyclic("month", 12, "sin"), "month_cos": cyclic("month", 12, "cos"),
    })


CYCLIC_COLUMNS = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
