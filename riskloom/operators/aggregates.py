"""Aggregations A01–A19.

Every grouped aggregate is a hash aggregate with partial (map-side) combine, so
a hot key is reduced to one row per map task before the shuffle.  Rates are
``avg`` of the 0/1 success column; ties are broken by the key so that
rankings are deterministic (D5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.quantiles import exact_quantile  # noqa: F401  (A18)

from riskloom import constants as K


def overview(df: DataFrame, label: str = "success") -> DataFrame:          # A01
    return df.agg(
        F.count(F.lit(1)).alias("incidents"),
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("successes"),
        (F.avg(label) * 100).alias("success_pct"),
    )


def kpi_panel(incidents: DataFrame, threats: DataFrame) -> DataFrame:       # A02
    """Dashboard KPIs in one aggregation.

    The catalogue count comes from the same pass: both tables are unioned with
    an origin flag, so no join (and no cross product of two one-row frames) is
    needed.
    """
    inc = incidents.select(F.lit(1).alias("is_incident"), "enterprise_type", "region", "threat_code",
                           "success", "host_count")
    thr = threats.select(F.lit(0).alias("is_incident"))
    u = inc.unionByName(thr, allowMissingColumns=True)
    return u.agg(
        F.sum("is_incident").cast("bigint").alias("incidents"),
        F.sum(1 - F.col("is_incident")).cast("bigint").alias("threats_in_catalog"),
        F.count_distinct("enterprise_type").alias("enterprise_types"),
        F.count_distinct("region").alias("regions"),
        F.count_distinct("threat_code").alias("threat_codes"),
        (F.avg("success") * 100).alias("success_pct"),
        F.avg("host_count").alias("mean_hosts"),
    )


def success_rate_by(df: DataFrame, key: str, label: str = "success") -> DataFrame:   # A03–A06
    return df.groupBy(key).agg(F.avg(label).alias("success_rate"))


def rate_and_count_by(df: DataFrame, key: str, label: str = "success", min_support: int = 0,
                      percent: bool = False) -> DataFrame:                            # A07, A08, A10
    rate = F.avg(label) * 100 if percent else F.avg(label)
    out = df.groupBy(key).agg(rate.alias("success_pct" if percent else "success_rate"),
                              F.count(F.lit(1)).alias("n"))
    if min_support:
        out = out.where(F.col("n") >= min_support)                                    # F05
    return out


def threat_success(df: DataFrame, min_support: int = K.THREAT_MIN_SUPPORT, k: int = K.TOP_K) -> DataFrame:  # A09
    """Success rate by threat *name* (D25), groups with at least ``min_support`` rows, top ``k``.

    ``df`` is either incidents already carrying ``threat_name`` or the output
    of :func:`threat_name_stats` (columns threat_name, success_rate, n).
    """
    if "n" in df.columns and "success_rate" in df.columns:
        stats = df.where(F.col("n") >= min_support)
    else:
        named = df.where(F.col("threat_name").isNotNull())
        stats = rate_and_count_by(named, "threat_name", min_support=min_support)
    return stats.orderBy(F.desc("success_rate"), F.asc("threat_name")).limit(k)


def threat_name_stats(incidents: DataFrame, threats: DataFrame, label: str = "success") -> DataFrame:
    """(threat_name, success_rate, n) with the aggregation pushed below the name join.

    Incidents are first reduced to one row per threat code (partial
    aggregation), so the catalogue join sees #codes rows instead of every
    incident; the per-name rate is then sum / count, exactly the mean over the
    incidents.  Codes without a catalogue entry have no name and drop out (D4).
    """
    by_code = incidents.groupBy("threat_code").agg(F.sum(label).cast("bigint").alias("_s"),
                                                   F.count(F.lit(1)).alias("_n"))
    names = threats.select(F.col("threat_id").cast("int").alias("threat_code"), F.col("name").alias("threat_name"))
    named = by_code.join(names, "threat_code")
    return named.groupBy("threat_name").agg((F.sum("_s").cast("double") / F.sum("_n")).alias("success_rate"),
                                            F.sum("_n").cast("bigint").alias("n"))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:               # A11
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def distinct_values(df: DataFrame, key: str) -> DataFrame:                         # A16 (+F13)
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def class_balance(df: DataFrame, label: str = "success") -> DataFrame:              # A17
    y = F.col(label)
    return df.agg(
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("n_neg"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("n_pos"),
    ).withColumn("imbalance_ratio", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")))


def mean_std(df: DataFrame, cols) -> DataFrame:                                    # A19
    """One row: ``<c>_mean`` and population ``<c>_std`` for every column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
    return df.agg(*aggs)
