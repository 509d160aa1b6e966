"""The dashboard's frames from one lazily filtered incident view.

The sidebar filters (F01–F03) become one ``where`` that reaches the Parquet
scan; every frame below is a small aggregate over that same plan, so each is
one job.  Charts are not drawn: the frames behind them are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import calendar as cal
from riskloom.operators import aggregates as A
from riskloom.operators import enrich as E
from riskloom.operators import filters as FL
from riskloom.operators import pivots as V
from riskloom.operators import topk as W
from riskloom.streaming.alerts import latest_attack


def facet_values(incidents: DataFrame) -> dict[str, DataFrame]:                 # A16 + F13
    return {"enterprise_type": A.distinct_values(incidents, "enterprise_type"),
            "region": A.distinct_values(incidents, "region")}


def frames(incidents: DataFrame, threats: DataFrame, types=None, regions=None, mode: str = "all",
           as_of: Column | None = None) -> dict[str, DataFrame]:
    view = cal.with_calendar(FL.dashboard_filter(incidents, types, regions, mode))
    named = E.join_threat_names(view, threats)
    out = {
        "kpis": A.kpi_panel(view, threats),                                      # A02
        "top_industries": W.top_k_by_count(view, "enterprise_type"),            # W04
        "top_regions": W.top_k_by_count(view, "region"),                        # W05
        "industry_success_pct": A.rate_and_count_by(view, "enterprise_type", min_support=K.INDUSTRY_MIN_SUPPORT,
                                                    percent=True),               # A10
        "top_threats": W.top_k_by_count(named, "threat_name"),                  # W06
        "by_hour": A.count_by(view, "hour"),                                     # A11
        "by_weekday": A.count_by(view, "dow").withColumn("day_name", cal.weekday_name("dow")),   # A12
        "by_season": A.count_by(FL.season_domain(view.withColumn("season_display", F.initcap("season"))),
                                "season_display"),                               # A13
        "weekday_hour": V.weekday_hour_counts(view),                             # V04
    }
    if as_of is not None:
        out["alert"] = latest_attack(view, as_of)                                # T01
    return out
