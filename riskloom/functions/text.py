"""Text and display expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.wallclock import fmt_day_first


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_text(x) -> Column:
    """Python ``str(x)`` of a value: null becomes the text 'None' (pandas astype(str))."""
    return F.coalesce(_c(x).cast("string"), F.lit("None"))


def join_key(*parts) -> Column:                 # P10, P11
    return F.concat_ws("_", *[as_text(p) for p in parts])


def truncate(x, width: int) -> Column:          # P15; null or empty -> ""
    x = _c(x)
    return (F.when(x.isNull() | (x == ""), F.lit(""))
            .when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit(K.ELLIPSIS)))
            .otherwise(x))


def flag_int(x) -> Column:                      # P16 (threats): 1/0, null -> 0
    return F.coalesce(_c(x).cast("int"), F.lit(0))


def flag_text(x) -> Column:                     # P16 (incidents): "1"/"0"
    return flag_int(x).cast("string")


def fmt_date(x) -> Column:                      # P17
    return F.coalesce(fmt_day_first(_c(x), with_time=False), F.lit(""))


def fmt_datetime(x) -> Column:                  # P17
    return F.coalesce(fmt_day_first(_c(x)), F.lit(""))


def or_empty(x) -> Column:                      # P18
    x = _c(x)
    return F.when(x.isNull() | (x == ""), F.lit("")).otherwise(x)


def incident_label(code, threat, region) -> Column:   # P25
    return F.concat(F.lit(K.INCIDENT_LABEL), as_text(code), F.lit(" | "), F.lit(K.THREAT_LABEL),
                    as_text(threat), F.lit(" | "), as_text(region))


def threat_label(threat_id, name) -> Column:          # P25
    return F.concat(F.lit(K.THREAT_LABEL), as_text(threat_id), F.lit(": "), as_text(name))


def alert_text(enterprise_type, region) -> Column:    # P24
    return F.concat(F.lit(K.ALERT_PREFIX), F.coalesce(_c(enterprise_type), F.lit(K.UNKNOWN)),
                    F.lit(K.ALERT_REGION), F.coalesce(_c(region), F.lit(K.UNKNOWN)))


def title(x) -> Column:
    """Every letter that follows no letter in upper case, all others in lower case ('north-west' is 'North-West').

    ``initcap`` knows words by spaces only, so one is put, behind a mark, before a letter that follows another sign.
    """
    marked = F.regexp_replace(_c(x), r"(?<=[^\p{L} ])(?=\p{L})", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def forecast_card(region, industry, hour, day, prob) -> Column:   # P24 (scoring card)
    """The forecast as text: a heading and four lines between two rules."""
    line = F.lit(K.FORECAST_RULE)
    return F.array_join(F.array(
        line, F.lit(K.FORECAST_HEADING),
        F.concat(F.lit(K.FORECAST_REGION), title(F.coalesce(_c(region), F.lit(K.UNKNOWN)))),
        F.concat(F.lit(K.FORECAST_INDUSTRY), title(F.coalesce(_c(industry), F.lit(K.UNKNOWN)))),
        F.format_string(K.FORECAST_TIME, F.lpad(F.coalesce(_c(hour), F.lit(0)).cast("string"), 2, "0"), F.coalesce(_c(day), F.lit(0))),
        F.format_string(K.FORECAST_CHANCE, _c(prob) * 100), line), "\n")


def threat_display(df: DataFrame) -> DataFrame:       # P26, threats: 12 columns
    return df.select(
        F.col("threat_id"),
        F.col("name"),
        truncate("description", K.DESCRIPTION_WIDTH).alias("description"),
        truncate("threat_source", K.SOURCE_WIDTH).alias("threat_source"),
        F.col("target_object"),
        flag_int("confidentiality_breach").alias("confidentiality_breach"),
        flag_int("integrity_breach").alias("integrity_breach"),
        flag_int("availability_breach").alias("availability_breach"),
        fmt_date("date_added").alias("date_added"),
        fmt_date("last_modified").alias("last_modified"),
        F.col("status"),
        or_empty("notes").alias("notes"),
    )


def incident_display(df: DataFrame) -> DataFrame:     # P26, incidents: 8 columns
    return df.select(
        F.col("enterprise_type"),
        F.col("enterprise_code"),
        F.col("host_count"),
        F.col("threat_code"),
        flag_text("success").alias("success"),
        F.col("region"),
        fmt_date("incident_date").alias("incident_date"),
        fmt_datetime("incident_time").alias("incident_time"),
    )
