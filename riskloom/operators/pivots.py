"""Pivots V01–V04.

Pivot values are always passed explicitly: no extra job to discover them and
a fixed output schema even when a value has no rows (D7 → null column).
The pivot is a grouped aggregate on (row key, pivot key) with partial
combine, then a per-row-key fold; the shuffle carries at most
rows × values partial results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.calendar import weekday_name
from riskloom.operators.filters import in_top_k
from riskloom.session import reliable_checkpoint

HOURS = list(range(24))
MONTHS = list(range(1, 13))


def hour_col(h: int) -> str:
    return f"h{h:02d}"


def month_col(m: int) -> str:
    return f"m{m:02d}"


def _rename(df: DataFrame, values, namer) -> DataFrame:
    return df.withColumnsRenamed({str(v): namer(v) for v in values})


def weekday_hour_rate(df: DataFrame, label: str = "success") -> DataFrame:      # V01
    p = df.groupBy("dow").pivot("hour", HOURS).agg(F.avg(label))
    return _rename(p, HOURS, hour_col)


def season_month_rate(df: DataFrame, label: str = "success") -> DataFrame:      # V02
    p = df.groupBy("season").pivot("month", MONTHS).agg(F.avg(label))
    return _rename(p, MONTHS, month_col)


def weekday_hour_counts(df: DataFrame) -> DataFrame:                            # V04
    p = df.groupBy("dow").pivot("hour", HOURS).agg(F.count(F.lit(1)))
    p = _rename(p, HOURS, hour_col).na.fill(0, [hour_col(h) for h in HOURS])
    return p.withColumn("day", F.coalesce(weekday_name("dow"), F.col("dow").cast("string")))


def industry_threat_long(df: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """V03 in long form: (enterprise_type, threat_code, n) over the top-k × top-k cells present.

    The incidents are read once, to count the pairs; both rankings and the cells come from the counted pairs.
    """
    pairs = reliable_checkpoint(df.groupBy("enterprise_type", "threat_code").agg(F.count(F.lit(1)).alias("n")))
    cells = pairs
    for key in ("enterprise_type", "threat_code"):
        top = pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("_n")).orderBy(
            F.desc("_n"), F.asc(key)).limit(k)
        cells = in_top_k(cells, top, key)                     # F11 / J02: k rows, broadcast
    return cells.select("enterprise_type", "threat_code", "n")


def industry_threat_matrix(df: DataFrame, k: int = K.TOP_K) -> tuple[DataFrame, list[int]]:   # V03
    """Crosstab of the k commonest industries × the k commonest threat codes; the k codes are the pivot's columns."""
    cells = industry_threat_long(df, k)
    codes = sorted(r["threat_code"] for r in cells.select("threat_code").distinct().collect())    # at most k
    p = cells.groupBy("enterprise_type").pivot("threat_code", codes).agg(F.first("n"))
    return p.na.fill(0, [str(c) for c in codes]), codes
