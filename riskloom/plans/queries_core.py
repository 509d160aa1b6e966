"""Registered queries for projections, filters, joins, aggregates, top-k and pivots.

Each builder reads the driver tables through the fixture views and applies
library operators; the SQL beside it is the independent DuckDB oracle.
Doubles that are sums of non-integers are rounded to 9 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import calendar as cal
from riskloom.functions import text as tx
from riskloom.functions.wallclock import ntz_lit
from riskloom.operators import aggregates as A
from riskloom.operators import enrich as E
from riskloom.operators import filters as FL
from riskloom.operators import grouped as G
from riskloom.operators import paging as PG
from riskloom.operators import pivots as V
from riskloom.operators import topk as W
from riskloom.plans import dashboard
from riskloom.plans.registry import register
from riskloom.plans.sqltext import q
from riskloom.sources import tables as T


def li_cal(spark, d):
    return cal.with_calendar(T.incidents_li(spark, d))


def ev_cal(spark, d):
    return cal.with_calendar(T.incidents_ev(spark, d))


def li_features(spark, d):
    return E.feature_frame(T.incidents_li(spark, d), T.threats(spark, d))


# ----------------------------------------------------------------- projections

@register("p01_p05_calendar_fields", q("SELECT incident_id, incident_time, hour, dow, month, season FROM cal",
                                       src="incidents_ev"), "P01", "P02", "P03", "P04", "P05")
def p01_p05(spark, d):
    return ev_cal(spark, d).select("incident_id", "incident_time", "hour", "dow", "month", "season")


@register("p06_weekday_names", q("""SELECT incident_id, dow,
    (['Пн','Вт','Ср','Чт','Пт','Сб','Вс'])[dow + 1] AS day_name FROM cal""", src="incidents_ev"), "P06")
def p06(spark, d):
    return ev_cal(spark, d).select("incident_id", "dow", cal.weekday_name("dow").alias("day_name"))


@register("p07_p09_time_flags", q("""SELECT incident_id, hour, dow,
    CAST(dow IN (5, 6) AS INTEGER) AS is_weekend,
    CAST(hour >= 22 OR hour <= 5 AS INTEGER) AS night_attack,
    CAST(hour BETWEEN 9 AND 18 AS INTEGER) AS working_hours FROM cal""", src="incidents_ev"), "P07", "P08", "P09")
def p07_p09(spark, d):
    return cal.with_time_flags(ev_cal(spark, d)).select(
        "incident_id", "hour", "dow", "is_weekend", "night_attack", "working_hours")


@register("p10_p11_concat_keys", q("""SELECT incident_id,
    region || '_' || enterprise_type AS region_industry,
    enterprise_type || '_' || CAST(threat_code AS VARCHAR) AS industry_threat,
    enterprise_type || '_0' AS industry_threat_scoring FROM cal""", src="incidents_ev"), "P10", "P11")
def p10_p11(spark, d):
    return ev_cal(spark, d).select(
        "incident_id", tx.join_key("region", "enterprise_type").alias("region_industry"),
        tx.join_key("enterprise_type", "threat_code").alias("industry_threat"),
        tx.join_key("enterprise_type", F.lit(0)).alias("industry_threat_scoring"))


@register("p12_p14_cyclic_features", q("""SELECT incident_id,
    round(sin(2 * pi() * hour / 24.0), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24.0), 9) + 0.0 AS hour_cos,
    round(sin(2 * pi() * dow / 7.0), 9) + 0.0 AS dow_sin, round(cos(2 * pi() * dow / 7.0), 9) + 0.0 AS dow_cos,
    round(sin(2 * pi() * month / 12.0), 9) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12.0), 9) + 0.0 AS month_cos
    FROM cal""", src="incidents_ev"), "P12", "P13", "P14")
def p12_p14(spark, d):
    df = cal.with_cyclic(ev_cal(spark, d))
    return df.select("incident_id", *[F.round(c, 9).alias(c) for c in cal.CYCLIC_COLUMNS])


@register("p15_p18_threat_display", q("""SELECT threat_id, name,
    CASE WHEN description IS NULL OR description = '' THEN ''
         WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END AS description,
    CASE WHEN threat_source IS NULL OR threat_source = '' THEN ''
         WHEN length(threat_source) > 40 THEN substr(threat_source, 1, 40) || '...' ELSE threat_source END AS threat_source,
    target_object,
    coalesce(CAST(confidentiality_breach AS INTEGER), 0) AS confidentiality_breach,
    coalesce(CAST(integrity_breach AS INTEGER), 0) AS integrity_breach,
    coalesce(CAST(availability_breach AS INTEGER), 0) AS availability_breach,
    coalesce(strftime(date_added, '%d.%m.%Y'), '') AS date_added,
    coalesce(strftime(last_modified, '%d.%m.%Y'), '') AS last_modified,
    status, coalesce(notes, '') AS notes
    FROM whole_catalog""", src="whole_catalog", cal=False), "P15", "P16", "P17", "P18", "P26")
def p15_p18(spark, d):
    return tx.threat_display(T.whole_catalog(spark, d))


@register("p26_incident_display", q("""SELECT enterprise_type, enterprise_code, host_count, threat_code,
    CAST(coalesce(success, 0) AS VARCHAR) AS success, region,
    coalesce(strftime(incident_date, '%d.%m.%Y'), '') AS incident_date,
    coalesce(strftime(incident_time, '%d.%m.%Y %H:%M'), '') AS incident_time
    FROM incidents_li""", cal=False), "P16", "P17", "P26")
def p26(spark, d):
    return tx.incident_display(T.incidents_li(spark, d))


@register("p25_row_labels", q("""SELECT 'Инцидент ' || enterprise_code || ' | Угроза ' || CAST(threat_code AS VARCHAR)
    || ' | ' || region AS label FROM incidents_ev
    UNION ALL SELECT 'Угроза ' || CAST(threat_id AS VARCHAR) || ': ' || name FROM all_threats""",
    src="incidents_ev", cal=False, views=("all_threats",)), "P25")
def p25(spark, d):
    inc = T.incidents_ev(spark, d).select(tx.incident_label("enterprise_code", "threat_code", "region").alias("label"))
    thr = T.all_threats(spark, d).select(tx.threat_label("threat_id", "name").alias("label"))
    return inc.unionByName(thr)


# ----------------------------------------------------------------- joins / windows

@register("j01_threat_name_join", q("""SELECT c.enterprise_code, c.incident_time, c.threat_code, t.name AS threat_name
    FROM incidents_li c LEFT JOIN threats t ON t.threat_id = c.threat_code""", cal=False, views=("threats",)), "J01")
def j01(spark, d):
    inc = T.incidents_li(spark, d)
    return E.join_threat_names(inc, T.threats(spark, d)).select(
        "enterprise_code", "incident_time", "threat_code", "threat_name")


@register("w01_w03_frequencies", q("""SELECT enterprise_code, incident_time, region_freq, industry_freq, threat_freq,
    threat_name FROM feat""", feat=True), "W01", "W02", "W03", "J01")
def w01_w03(spark, d):
    return li_features(spark, d).select("enterprise_code", "incident_time", "region_freq", "industry_freq",
                                        "threat_freq", "threat_name")


@register("features_full_frame", q("""SELECT enterprise_type, enterprise_code, host_count, threat_code, success, region,
    incident_date, incident_time, hour, dow, month, season, threat_name, threat_freq, region_freq, industry_freq,
    is_weekend, night_attack, working_hours, region_industry, industry_threat,
    round(hour_sin, 9) + 0.0 AS hour_sin, round(hour_cos, 9) + 0.0 AS hour_cos, round(dow_sin, 9) + 0.0 AS dow_sin,
    round(dow_cos, 9) + 0.0 AS dow_cos, round(month_sin, 9) + 0.0 AS month_sin, round(month_cos, 9) + 0.0 AS month_cos
    FROM feat""", feat=True), "J01", "W01", "W02", "W03", "P01", "P02", "P03", "P04", "P07", "P08", "P09",
    "P10", "P11", "P12", "P13", "P14")
def features_full(spark, d):
    df = li_features(spark, d)
    cols = ["enterprise_type", "enterprise_code", "host_count", "threat_code", "success", "region",
            "incident_date", "incident_time", "hour", "dow", "month", "season", "threat_name", "threat_freq",
            "region_freq", "industry_freq", "is_weekend", "night_attack", "working_hours", "region_industry",
            "industry_threat"]
    return df.select(*cols, *[F.round(c, 9).alias(c) for c in cal.CYCLIC_COLUMNS])


# ----------------------------------------------------------------- aggregates

@register("a01_overview", q("""SELECT count(*) AS incidents, CAST(coalesce(sum(success), 0) AS BIGINT) AS successes,
    avg(success) * 100 AS success_pct FROM incidents_li""", cal=False), "A01", "P21")
def a01(spark, d):
    return A.overview(T.incidents_li(spark, d))


@register("a02_kpi_panel", q("""SELECT (SELECT count(*) FROM incidents_li) AS incidents,
    (SELECT count(*) FROM all_threats) AS threats_in_catalog,
    count(DISTINCT enterprise_type) AS enterprise_types, count(DISTINCT region) AS regions,
    count(DISTINCT threat_code) AS threat_codes, avg(success) * 100 AS success_pct,
    avg(host_count) AS mean_hosts FROM incidents_li""", cal=False, views=("all_threats",)), "A02")
def a02(spark, d):
    return A.kpi_panel(T.incidents_li(spark, d), T.all_threats(spark, d))


def _rate_query(key):
    return q(f"SELECT {key}, avg(success) AS success_rate FROM cal GROUP BY {key}")


@register("a03_rate_by_hour", _rate_query("hour"), "A03")
def a03(spark, d):
    return A.success_rate_by(li_cal(spark, d), "hour")


@register("a04_rate_by_weekday", _rate_query("dow"), "A04")
def a04(spark, d):
    return A.success_rate_by(li_cal(spark, d), "dow")


@register("a05_rate_by_month", _rate_query("month"), "A05")
def a05(spark, d):
    return A.success_rate_by(li_cal(spark, d), "month")


@register("a06_rate_by_season", _rate_query("season"), "A06")
def a06(spark, d):
    return A.success_rate_by(li_cal(spark, d), "season")


@register("a07_industry_rate_count", q("""SELECT enterprise_type, avg(success) AS success_rate, count(*) AS n
    FROM incidents_li GROUP BY enterprise_type""", cal=False), "A07", "R01")
def a07(spark, d):
    return A.rate_and_count_by(T.incidents_li(spark, d), "enterprise_type")


@register("a08_region_rate_count", q("""SELECT region, avg(success) AS success_rate, count(*) AS n
    FROM incidents_li GROUP BY region""", cal=False), "A08", "R01")
def a08(spark, d):
    return A.rate_and_count_by(T.incidents_li(spark, d), "region")


A09_SQL = q("""SELECT t.name AS threat_name, avg(c.success) AS success_rate, count(*) AS n
    FROM incidents_li c JOIN threats t ON t.threat_id = c.threat_code
    GROUP BY t.name HAVING count(*) >= 10
    ORDER BY success_rate DESC, threat_name ASC LIMIT 10""", cal=False, views=("threats",))


@register("a09_threat_success_min_support", A09_SQL, "A09", "F05", "J01", "R01")
def a09(spark, d):
    return A.threat_success(A.threat_name_stats(T.incidents_li(spark, d), T.threats(spark, d)))


@register("a10_industry_pct_min_support", q("""SELECT enterprise_type, avg(success) * 100 AS success_pct, count(*) AS n
    FROM incidents_li GROUP BY enterprise_type HAVING count(*) >= 5""", cal=False), "A10", "F05", "P21")
def a10(spark, d):
    return A.rate_and_count_by(T.incidents_li(spark, d), "enterprise_type", min_support=K.INDUSTRY_MIN_SUPPORT,
                               percent=True)


@register("a11_count_by_hour", q("SELECT hour, count(*) AS n FROM cal GROUP BY hour", src="incidents_ev"), "A11")
def a11(spark, d):
    return A.count_by(ev_cal(spark, d), "hour")


@register("a12_count_by_weekday", q("""SELECT dow, count(*) AS n,
    (['Пн','Вт','Ср','Чт','Пт','Сб','Вс'])[dow + 1] AS day_name FROM cal GROUP BY dow""", src="incidents_ev"),
    "A12", "P06")
def a12(spark, d):
    return A.count_by(ev_cal(spark, d), "dow").withColumn("day_name", cal.weekday_name("dow"))


@register("a13_count_by_season", q("""SELECT season_display, count(*) AS n FROM (
    SELECT upper(substr(season, 1, 1)) || substr(season, 2) AS season_display FROM cal)
    WHERE season_display IN ('Зима', 'Весна', 'Лето', 'Осень') GROUP BY season_display"""), "A13", "F12")
def a13(spark, d):
    df = li_cal(spark, d).withColumn("season_display", F.initcap("season"))
    return A.count_by(FL.season_domain(df), "season_display")


@register("a16_facet_values", q("""SELECT 'enterprise_type' AS facet, enterprise_type AS value FROM incidents_li
    WHERE enterprise_type IS NOT NULL GROUP BY enterprise_type
    UNION ALL SELECT 'region', region FROM incidents_li WHERE region IS NOT NULL GROUP BY region""", cal=False),
    "A16", "F13")
def a16(spark, d):
    return G.distinct_values(T.incidents_li(spark, d), ["enterprise_type", "region"])


@register("a17_class_balance", q("""SELECT CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
    CAST(sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
    CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS DOUBLE)
      / nullif(sum(CASE WHEN success = 1 THEN 1 ELSE 0 END), 0) AS imbalance_ratio
    FROM incidents_li""", cal=False), "A17", "M12")
def a17(spark, d):
    return A.class_balance(T.incidents_li(spark, d))


@register("a18_quantile_by_region", q("""SELECT region, quantile_cont(CAST(host_count AS DOUBLE), 0.3) AS quantile
    FROM incidents_li GROUP BY region""", cal=False), "A18")
def a18(spark, d):
    return A.exact_quantile(T.incidents_li(spark, d), "host_count", K.IMPORTANCE_QUANTILE, by="region")


@register("a19_mean_std", q("""SELECT """ + ", ".join(
    f"round(avg(CAST({c} AS DOUBLE)), 9) AS {c}_mean, round(stddev_pop(CAST({c} AS DOUBLE)), 9) AS {c}_std"
    for c in ("host_count", "hour", "dow", "month")) + " FROM cal"), "A19", "M03")
def a19(spark, d):
    m = A.mean_std(li_cal(spark, d), ["host_count", "hour", "dow", "month"])
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


# ----------------------------------------------------------------- top-k

def _top_sql(key, src="incidents_li"):
    return q(f"""SELECT {key}, count(*) AS n FROM {src} WHERE {key} IS NOT NULL GROUP BY {key}
    ORDER BY n DESC, {key} ASC LIMIT 10""", src=src, cal=False)


@register("w04_top_industries", _top_sql("enterprise_type"), "W04")
def w04(spark, d):
    return W.top_k_by_count(T.incidents_li(spark, d), "enterprise_type")


@register("w05_top_regions", _top_sql("region"), "W05")
def w05(spark, d):
    return W.top_k_by_count(T.incidents_li(spark, d), "region")


@register("w06_top_threat_names", q("""SELECT t.name AS threat_name, count(*) AS n
    FROM incidents_li c LEFT JOIN threats t ON t.threat_id = c.threat_code
    WHERE t.name IS NOT NULL GROUP BY t.name ORDER BY n DESC, threat_name ASC LIMIT 10""",
    cal=False, views=("threats",)), "W06", "J01")
def w06(spark, d):
    stats = A.threat_name_stats(T.incidents_li(spark, d), T.threats(spark, d))
    return stats.orderBy(F.desc("n"), F.asc("threat_name")).limit(K.TOP_K).select("threat_name", "n")


@register("w07_top_threat_codes", _top_sql("threat_code"), "W07")
def w07(spark, d):
    return W.top_k_by_count(T.incidents_li(spark, d), "threat_code")


@register("w08_peak_times", q("""SELECT * FROM (
    (SELECT 'hour' AS dimension, CAST(hour AS VARCHAR) AS best, avg(success) AS success_rate FROM cal
      GROUP BY hour ORDER BY success_rate DESC, hour ASC LIMIT 1)
    UNION ALL (SELECT 'dow', CAST(dow AS VARCHAR), avg(success) AS r FROM cal GROUP BY dow ORDER BY r DESC, dow LIMIT 1)
    UNION ALL (SELECT 'month', CAST(month AS VARCHAR), avg(success) AS r FROM cal GROUP BY month
      ORDER BY r DESC, month LIMIT 1)
    UNION ALL (SELECT 'season', season, avg(success) AS r FROM cal GROUP BY season ORDER BY r DESC, season LIMIT 1))"""),
    "W08", "A03", "A04", "A05", "A06")
def w08(spark, d):
    keys = ["hour", "dow", "month", "season"]
    best = G.best_of_each(G.by_each(li_cal(spark, d), keys, "success"), keys, dict.fromkeys(keys, 1))
    return best.select("dimension", F.col("value").alias("best"), "success_rate")


_ADMIN_ORDER = ("incident_date DESC, incident_time DESC, enterprise_code, threat_code, host_count, success, "
                "region, enterprise_type")


@register("w10_admin_first_page", q(f"""SELECT * FROM incidents_li ORDER BY {_ADMIN_ORDER} LIMIT 100""", cal=False),
          "W10")
def w10(spark, d):
    return W.default_order(T.incidents_li(spark, d), page=100)


@register("w10_admin_order", q(f"""SELECT *, row_number() OVER (ORDER BY {_ADMIN_ORDER}) > 100 AS later_page
    FROM incidents_li""", cal=False), "W10")
def w10_full(spark, d):
    """Every page: the first, and all that comes after it."""
    ranked = PG.with_position(T.incidents_li(spark, d), W.DEFAULT_ORDER)
    return ranked.withColumn("later_page", F.col("position") > 100).drop("position")


@register("w10_admin_positions", q(f"""SELECT *, row_number() OVER (ORDER BY {_ADMIN_ORDER}, incident_id) AS position
    FROM incidents_ev""", src="incidents_ev", cal=False), "W10")
def w10_positions(spark, d):
    """The place of every incident in the default order, with a column that the order does not name."""
    return PG.with_position(T.incidents_ev(spark, d), W.DEFAULT_ORDER)


@register("w10_admin_second_page", q(f"""SELECT * FROM incidents_li ORDER BY {_ADMIN_ORDER} LIMIT 100 OFFSET 100""",
          cal=False), "W10")
def w10_second_page(spark, d):
    """The second page, from a cursor behind the first one."""
    inc = T.incidents_li(spark, d)
    first = PG.page_after(inc, W.DEFAULT_ORDER, 100).collect()           # one page of 100 rows
    return PG.page_after(inc, W.DEFAULT_ORDER, 100, PG.cursor_after(first))


_HOSTS_ORDER = ("host_count DESC, incident_date, incident_time, enterprise_code, threat_code, success, region, "
                "enterprise_type")


@register("w11_hosts_positions", q(f"""SELECT *, row_number() OVER (ORDER BY {_HOSTS_ORDER}) AS position
    FROM incidents_li""", cal=False), "W11")
def w11_positions(spark, d):
    """The place of every incident in the order by hosts."""
    order = [("host_count", True), *((c, False) for c in ("incident_date", "incident_time", "enterprise_code", "threat_code",
                                                          "success", "region", "enterprise_type"))]
    return PG.with_position(T.incidents_li(spark, d), order)


@register("w11_order_by_hosts", q("""SELECT * FROM incidents_li ORDER BY host_count DESC, incident_date,
    incident_time, enterprise_code, threat_code, success, region, enterprise_type LIMIT 100""", cal=False), "W11")
def w11(spark, d):
    return W.order_by_column(T.incidents_li(spark, d), "host_count", descending=True, page=100,
                             tie_break=("incident_date", "incident_time", "enterprise_code", "threat_code",
                                        "success", "region", "enterprise_type"))


@register("w13_sample_row", q("""SELECT * FROM incidents_ev
    ORDER BY md5('42|' || CAST(incident_id AS VARCHAR)), incident_id LIMIT 1""", src="incidents_ev", cal=False),
    "W13")
def w13(spark, d):
    return W.sample_one(T.incidents_ev(spark, d), K.SPLIT_SEED, ["incident_id"])


# ----------------------------------------------------------------- pivots

def _pivot_rate_sql(row, col, values, namer, agg="avg(success)"):
    cols = ", ".join(f"{agg.replace('success', f'CASE WHEN {col} = {v} THEN success END')} AS {namer(v)}"
                     for v in values)
    return q(f"SELECT {row}, {cols} FROM cal GROUP BY {row}")


@register("v01_weekday_hour_rate", _pivot_rate_sql("dow", "hour", V.HOURS, V.hour_col), "V01")
def v01(spark, d):
    return V.weekday_hour_rate(li_cal(spark, d))


@register("v02_season_month_rate", _pivot_rate_sql("season", "month", V.MONTHS, V.month_col), "V02")
def v02(spark, d):
    return V.season_month_rate(li_cal(spark, d))


@register("v03_industry_threat_matrix", q("""SELECT enterprise_type, threat_code, count(*) AS n FROM incidents_li
    WHERE threat_code IN (SELECT threat_code FROM incidents_li WHERE threat_code IS NOT NULL GROUP BY threat_code
                          ORDER BY count(*) DESC, threat_code LIMIT 10)
      AND enterprise_type IN (SELECT enterprise_type FROM incidents_li WHERE enterprise_type IS NOT NULL
                              GROUP BY enterprise_type ORDER BY count(*) DESC, enterprise_type LIMIT 10)
    GROUP BY enterprise_type, threat_code""", cal=False), "V03", "F11", "J02", "W04", "W07")
def v03(spark, d):
    return V.industry_threat_long(T.incidents_li(spark, d))


@register("v04_weekday_hour_counts", q("SELECT dow, " + ", ".join(
    f"count(*) FILTER (WHERE hour = {h}) AS {V.hour_col(h)}" for h in V.HOURS)
    + ", (['Пн','Вт','Ср','Чт','Пт','Сб','Вс'])[dow + 1] AS day FROM cal GROUP BY dow", src="incidents_ev"), "V04")
def v04(spark, d):
    return V.weekday_hour_counts(ev_cal(spark, d))


# ----------------------------------------------------------------- filters

_TYPES = ("BUILDING", "MACHINERY")
_REGIONS = ("NATION_1", "NATION_7", "NATION_12", "NATION_19", "NATION_24")


@register("f01_f03_dashboard_filter", q(f"""SELECT * FROM incidents_li WHERE enterprise_type IN {_TYPES}
    AND region IN {_REGIONS} AND success = 1""", cal=False), "F01", "F02", "F03")
def f01_f03(spark, d):
    return FL.dashboard_filter(T.incidents_li(spark, d), types=_TYPES, regions=_REGIONS, mode="success")


@register("f03_failures_only", q("SELECT * FROM incidents_li WHERE success = 0", cal=False), "F03")
def f03(spark, d):
    return FL.success_filter(T.incidents_li(spark, d), "failure")


@register("f04_recent_window", q("""SELECT * FROM incidents_ev
    WHERE incident_time > (SELECT max(incident_time) FROM incidents_ev) - INTERVAL 5 SECOND""",
    src="incidents_ev", cal=False), "F04")
def f04(spark, d):
    inc = T.incidents_ev(spark, d)
    as_of = inc.agg(F.max("incident_time")).first()[0]            # one scalar: the dashboard's "now"
    return FL.recent(inc, ntz_lit(as_of))


@register("f06_threat_facets", q("""SELECT * FROM whole_catalog WHERE status = 'Brand#3' AND target_object = 'SMALL'""",
    src="whole_catalog", cal=False), "F06")
def f06(spark, d):
    return FL.facets(T.whole_catalog(spark, d), status="Brand#3", target_object="SMALL")


@register("f07_incident_facets", q("""SELECT * FROM incidents_li WHERE success = 1 AND region = 'NATION_7'
    AND enterprise_type = 'BUILDING'""", cal=False), "F07")
def f07(spark, d):
    return FL.facets(T.incidents_li(spark, d), success=1, region="NATION_7", enterprise_type="BUILDING")


@register("f08_threat_search", q("""SELECT * FROM whole_catalog WHERE
    (contains(lower(name), 'red') OR contains(lower(CAST(threat_id AS VARCHAR)), 'red')
      OR contains(lower(description), 'red'))
    AND (contains(lower(name), 'brand#1') OR contains(lower(CAST(threat_id AS VARCHAR)), 'brand#1')
      OR contains(lower(description), 'brand#1'))""", src="whole_catalog", cal=False), "F08")
def f08(spark, d):
    return FL.search(T.whole_catalog(spark, d), "Red BRAND#1", ["name", "threat_id", "description"])


@register("f09_incident_search", q("""SELECT * FROM incidents_li WHERE
    (contains(lower(enterprise_code), '12') OR contains(lower(region), '12') OR contains(lower(enterprise_type), '12'))
    AND (contains(lower(enterprise_code), 'on_1') OR contains(lower(region), 'on_1')
      OR contains(lower(enterprise_type), 'on_1'))""", cal=False), "F09")
def f09(spark, d):
    return FL.search(T.incidents_li(spark, d), "12 ON_1", ["enterprise_code", "region", "enterprise_type"])


@register("f10_date_drilldown", q("""SELECT 'year' AS level, CAST(year(incident_date) AS INTEGER) AS value, count(*) AS n
    FROM incidents_li GROUP BY 2
    UNION ALL SELECT 'month', CAST(month(incident_date) AS INTEGER), count(*) FROM incidents_li
      WHERE incident_date >= DATE '1996-01-01' AND incident_date < DATE '1997-01-01' GROUP BY 2
    UNION ALL SELECT 'day', CAST(day(incident_date) AS INTEGER), count(*) FROM incidents_li
      WHERE incident_date >= DATE '1996-03-01' AND incident_date < DATE '1996-04-01' GROUP BY 2""", cal=False), "F10")
def f10(spark, d):
    return G.date_levels(T.incidents_li(spark, d), 1996, 3)


@register("f10_months_of_a_year", q("""SELECT CAST(month(incident_date) AS INTEGER) AS month, count(*) AS n FROM incidents_li
    WHERE incident_date >= DATE '1996-01-01' AND incident_date < DATE '1997-01-01' GROUP BY 1""", cal=False), "F10")
def f10_months(spark, d):
    """One level alone, with its range pushed to the scan."""
    return FL.date_drilldown(T.incidents_li(spark, d), year=1996)


@register("f11_top_k_subset", q("""SELECT * FROM incidents_li WHERE threat_code IN (SELECT threat_code FROM incidents_li
    WHERE threat_code IS NOT NULL GROUP BY threat_code ORDER BY count(*) DESC, threat_code LIMIT 10)""", cal=False), "F11", "J02", "M20")
def f11(spark, d):
    inc = T.incidents_li(spark, d)
    return FL.in_top_k(inc, W.top_k_by_count(inc, "threat_code"), "threat_code")


@register("f14_missing_column_guard", q("""SELECT incident_id, enterprise_type, enterprise_code, host_count, threat_code,
    success, region, incident_date FROM incidents_ev WHERE false""", src="incidents_ev", cal=False), "F14")
def f14(spark, d):
    inc = T.incidents_ev(spark, d).drop("incident_time")
    return FL.guard(inc, ["incident_time"])


@register("f14_guard_both_ways", q("""SELECT 'present' AS columns, incident_id FROM incidents_ev WHERE threat_code IS NOT NULL""",
          src="incidents_ev", cal=False), "F14")
def f14_both(spark, d):
    """Rows pass where the required columns are there, and none where one is missing."""
    inc = T.incidents_ev(spark, d).where(F.col("threat_code").isNotNull())
    out = FL.guard(inc, ["incident_time", "threat_code"]).select(F.lit("present").alias("columns"), "incident_id")
    return out.unionByName(FL.guard(inc.drop("incident_time"), ["incident_time", "threat_code"]).select(
        F.lit("missing").alias("columns"), "incident_id"))


# ----------------------------------------------------------------- the dashboard

_VIEW = f"view_ AS (SELECT * FROM cal WHERE enterprise_type IN {_TYPES} AND region IN {_REGIONS} AND success = 1)"


def _counted_sql(frame, key, top=False):
    limit = f" ORDER BY count(*) DESC, {key} LIMIT 10" if top else ""
    return f"(SELECT '{frame}' AS frame, CAST({key} AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM view_ " \
           f"WHERE {key} IS NOT NULL GROUP BY {key}{limit})"


@register("dashboard_all_frames", q(" UNION ALL ".join([
    *(f"SELECT 'kpis' AS frame, '{k}' AS key, CAST({x} AS DOUBLE) AS value FROM view_" for k, x in (
        ("incidents", "count(*)"), ("threats_in_catalog", "max((SELECT count(*) FROM all_threats))"), ("enterprise_types", "count(DISTINCT enterprise_type)"),
        ("regions", "count(DISTINCT region)"), ("threat_codes", "count(DISTINCT threat_code)"), ("success_pct", "avg(success) * 100"),
        ("mean_hosts", "avg(host_count)"))),
    _counted_sql("top_industries", "enterprise_type", True), _counted_sql("top_regions", "region", True),
    _counted_sql("by_hour", "hour"), _counted_sql("by_weekday", "dow"),
    """SELECT 'by_season', upper(substr(season, 1, 1)) || substr(season, 2), CAST(count(*) AS DOUBLE) FROM view_ GROUP BY 2""",
    """SELECT 'industry_success_pct', enterprise_type, avg(success) * 100 FROM view_ GROUP BY enterprise_type HAVING count(*) >= 5""",
    """(SELECT 'top_threats', t.name, CAST(count(*) AS DOUBLE) FROM view_ v JOIN all_threats t ON t.threat_id = v.threat_code
        GROUP BY t.name ORDER BY count(*) DESC, t.name LIMIT 10)"""]), src="incidents_ev", views=("all_threats",), ctes=(_VIEW,)),
    "F01", "F02", "F03", "A02", "A10", "A11", "A12", "A13", "W04", "W05", "W06")
def dashboard_frames(spark, d):
    """Every frame of the dashboard behind its three filters, as (frame, key, value)."""
    fr = dashboard.frames(T.incidents_ev(spark, d), T.all_threats(spark, d), _TYPES, _REGIONS, "success")
    kpis = fr["kpis"]
    parts = [kpis.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                                             for c in kpis.columns])).alias("k")).select(F.lit("kpis").alias("frame"), "k.*")]
    for name, key, value in (("top_industries", "enterprise_type", "n"), ("top_regions", "region", "n"), ("by_hour", "hour", "n"),
                             ("by_weekday", "dow", "n"), ("by_season", "season_display", "n"),
                             ("industry_success_pct", "enterprise_type", "success_pct"), ("top_threats", "threat_name", "n")):
        parts.append(fr[name].select(F.lit(name).alias("frame"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
