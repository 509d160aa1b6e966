"""Registered queries for sources, casts, upserts and sinks.

Round trips write data derived from the driver tables into a fresh folder
under the shared checkpoint folder and read it back with the readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import casts as C
from riskloom.functions.wallclock import fmt_day_first
from riskloom.plans import ingest
from riskloom.plans.registry import register
from riskloom.plans.sqltext import q
from riskloom.session import scratch_path
from riskloom.sources import sheets as SH
from riskloom.sources import sinks as SK
from riskloom.sources import tables as T
from riskloom.sources.upsert import upsert_last_wins


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("s01_threat_sheet_roundtrip", q("""SELECT threat_id, name, description, threat_source, target_object,
    CASE WHEN threat_id % 5 = 0 THEN true ELSE confidentiality_breach END AS confidentiality_breach,
    CASE WHEN threat_id % 5 = 0 THEN true ELSE integrity_breach END AS integrity_breach,
    CASE WHEN threat_id % 5 = 0 THEN true ELSE availability_breach END AS availability_breach,
    date_added, last_modified, status, notes FROM whole_catalog""", src="whole_catalog", cal=False),
    "S01", "S13", "P19", "S06")
def s01(spark, d):
    path = _fresh(spark, "threat-sheet")
    SH.write_threat_sheet(T.whole_catalog(spark, d), path)
    return SH.read_threat_sheet(spark, path)


@register("s01_sheet_rejected_rows", q("SELECT 2 + count(*) FILTER (WHERE notes IS NULL) AS rejected FROM whole_catalog",
          src="whole_catalog", cal=False), "S01")
def s01_rejected(spark, d):
    """Banner, header and, in this sheet, the rows without notes, which have no id either."""
    path, cat = _fresh(spark, "threat-sheet"), T.whole_catalog(spark, d)
    SH.write_threat_sheet(cat.withColumn("threat_id", F.when(F.col("notes").isNotNull(), F.col("threat_id"))), path)
    return SH.count_rejected(spark, path)


@register("s02_incident_sheet_roundtrip", q("""SELECT enterprise_type, enterprise_code, host_count, threat_code,
    success, region, incident_date, date_trunc('second', incident_time) AS incident_time FROM incidents_ev""",
    src="incidents_ev", cal=False), "S02", "S06", "S10", "P20")
def s02(spark, d):
    path = _fresh(spark, "incident-sheet")
    SH.write_incident_sheet(T.incidents_ev(spark, d), path)
    return SH.read_incident_sheet(spark, path)


_MOVED_TIMES = """SELECT enterprise_type, enterprise_code, host_count, threat_code, success, region, incident_date,
    date_trunc('second', incident_time) AS incident_time FROM incidents_ev"""


@register("s02_folder_of_sheets", q(_MOVED_TIMES, src="incidents_ev", cal=False), "S02", "S06", "S10", "P20")
def s02_folder(spark, d):
    """Two sheets in one folder, whose columns stand in other orders."""
    path, inc = _fresh(spark, "incident-sheets"), T.incidents_ev(spark, d)
    failed = F.col("success") == 0
    SH.write_incident_sheet(inc.where(failed), f"{path}/a")
    SH.write_incident_sheet(inc.where(~failed), f"{path}/b", ["Успех", "Код реализованной угрозы", "Количество хостов"])
    return SH.read_incident_sheet(spark, f"{path}/*")


@register("s01_folder_of_sheets", q("""SELECT threat_id, name, description, threat_source, target_object,
    CASE WHEN threat_id % 5 = 0 THEN true ELSE confidentiality_breach END AS confidentiality_breach,
    CASE WHEN threat_id % 5 = 0 THEN true ELSE integrity_breach END AS integrity_breach,
    CASE WHEN threat_id % 5 = 0 THEN true ELSE availability_breach END AS availability_breach,
    date_added, last_modified, status, notes FROM whole_catalog""", src="whole_catalog", cal=False),
    "S01", "S13", "P19", "S06")
def s01_folder(spark, d):
    """Two catalogue sheets in one folder, each with its banner, whose columns stand in other orders."""
    path, cat = _fresh(spark, "threat-sheets"), T.whole_catalog(spark, d)
    noted = F.col("notes").isNotNull()
    SH.write_threat_sheet(cat.where(noted), f"{path}/a")
    SH.write_threat_sheet(cat.where(~noted), f"{path}/b", first=["Замечания", "Статус угрозы"])
    return SH.read_threat_sheet(spark, f"{path}/*")


@register("s05_display_headers", q("""SELECT enterprise_type AS "Тип_предприятия", enterprise_code AS "Код_предприятия",
    host_count AS "Количество_хостов", threat_code AS "Код_реализованной_угрозы", success AS "Успех",
    region AS "Регион_размещения_предприятия", incident_date AS "Дата_инцидента",
    incident_time AS "Региональное_время" FROM incidents_ev""", src="incidents_ev", cal=False), "S05")
def s05(spark, d):
    df = T.incidents_ev(spark, d).drop("incident_id")
    return df.withColumnsRenamed(K.INCIDENT_HEADERS)


@register("s07_strict_casts", q("""SELECT CAST(enterprise_code AS BIGINT) AS enterprise_code,
    CAST(host_count AS BIGINT) AS host_count, CAST(threat_code AS BIGINT) AS threat_code,
    CAST(success AS BIGINT) AS success, enterprise_type, region FROM incidents_li""", cal=False), "S07")
def s07(spark, d):
    df = T.incidents_li(spark, d)
    return df.select(*[C.strict_cast(c, "bigint").alias(c) for c in
                       ("enterprise_code", "host_count", "threat_code", "success")], "enterprise_type", "region")


@register("s08_lenient_casts", """SELECT event_id,
    coalesce(TRY_CAST(trunc(TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS code_num,
    coalesce(TRY_CAST(trunc(TRY_CAST(props AS DOUBLE)) AS BIGINT), 0) AS props_num,
    coalesce(TRY_CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS value_num,
    coalesce(TRY_CAST(trunc(TRY_CAST(event_type AS DOUBLE)) AS BIGINT), 0) AS type_num
    FROM events""", "S08")
def s08(spark, d):
    e = T.table(spark, d, "events")
    return e.select("event_id", C.lenient_int(F.col("user_id").cast("string")).alias("code_num"),
                    C.lenient_int("props").alias("props_num"),
                    C.lenient_int(F.col("value").cast("string")).alias("value_num"),
                    C.lenient_int("event_type").alias("type_num"))


@register("s09_key_normalise", """SELECT p_partkey,
    CAST(split_part(CAST(p_partkey AS VARCHAR), '.', 1) AS INTEGER) AS key_from_id,
    CAST(split_part(CAST(p_retailprice AS VARCHAR), '.', 1) AS INTEGER) AS key_from_price
    FROM part""", "S09")
def s09(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", C.key_before_dot("p_partkey").alias("key_from_id"),
                    C.key_before_dot("p_retailprice").alias("key_from_price"))


@register("s10_dayfirst_parse", """SELECT event_id, txt,
    coalesce(try_strptime(txt, '%d.%m.%Y %H:%M:%S'), try_strptime(txt, '%d.%m.%Y %H:%M'),
             try_strptime(txt, '%d.%m.%Y')) AS parsed
    FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN props
                                WHEN event_id % 10 = 1 THEN strftime(ts, '%d.%m.%Y')
                                ELSE strftime(ts, '%d.%m.%Y %H:%M') END AS txt FROM events)""", "S10")
def s10(spark, d):
    e = T.table(spark, d, "events")
    txt = (F.when(F.col("event_id") % 10 == 0, F.col("props"))
           .when(F.col("event_id") % 10 == 1, fmt_day_first("ts", with_time=False))
           .otherwise(fmt_day_first("ts")))
    e = e.select("event_id", txt.alias("txt"))
    return e.select("event_id", "txt", C.parse_dayfirst("txt").alias("parsed"))


_UPSERT_SQL = q("""SELECT * EXCLUDE (_batch, _rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY threat_id ORDER BY _batch DESC) AS _rn FROM (
      SELECT *, 0 AS _batch FROM threat_catalog UNION ALL SELECT *, 1 AS _batch FROM catalog_revision))
    WHERE _rn = 1""", src="threat_catalog", cal=False, views=("catalog_revision",))


@register("s14_threat_upsert", _UPSERT_SQL, "S14")
def s14(spark, d):
    return upsert_last_wins([T.threat_catalog(spark, d), T.catalog_revision(spark, d)], ["threat_id"], [])


_LI_ORDER = ["host_count", "threat_code", "success", "enterprise_type", "region", "incident_date"]


@register("s15_incident_upsert", q("""SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY enterprise_code, incident_time
      ORDER BY host_count DESC, threat_code DESC, success DESC, enterprise_type DESC, region DESC,
               incident_date DESC) AS _rn FROM incidents_li) WHERE _rn = 1""", cal=False), "S15")
def s15(spark, d):
    return upsert_last_wins([T.incidents_li(spark, d)], ["enterprise_code", "incident_time"], _LI_ORDER)


@register("s15_last_of_many_in_a_batch", q("""SELECT * FROM incidents_ev QUALIFY row_number() OVER (PARTITION BY enterprise_code
    ORDER BY incident_id DESC) = 1""", src="incidents_ev", cal=False), "S15", "S14")
def s15_sequence(spark, d):
    """A batch with many rows for each key, in the order of a sequence: the last one wins, not the greatest."""
    return upsert_last_wins([T.incidents_ev(spark, d)], ["enterprise_code"], ["incident_id"])


@register("s14_last_batch_and_row_win", q("""SELECT threat_code, region, host_count, incident_id FROM (
    SELECT *, CAST(success = 1 AS INTEGER) AS batch FROM incidents_ev)
    QUALIFY row_number() OVER (PARTITION BY threat_code ORDER BY batch DESC, incident_id DESC) = 1""", src="incidents_ev", cal=False), "S14")
def s14_sequence(spark, d):
    """Two batches with repeats in both: a later batch wins, and inside it the later row."""
    inc = T.incidents_ev(spark, d).select("threat_code", "region", "host_count", "incident_id", "success")
    batches = [inc.where(F.col("success") != 1).drop("success"), inc.where(F.col("success") == 1).drop("success")]
    return upsert_last_wins(batches, ["threat_code"], ["incident_id"])


@register("s19_load_command", q("""SELECT 'threats' AS "table", count(*) AS rows FROM whole_catalog
    UNION ALL SELECT 'incidents', count(*) FROM (SELECT DISTINCT enterprise_code, date_trunc('second', incident_time) FROM incidents_ev)""",
    src="whole_catalog", cal=False, views=("incidents_ev",)), "S19", "S01", "S02", "S14", "S15", "S18")
def s19_load(spark, d):
    """The load command on both sheets, twice: the second load changes nothing."""
    thr, inc, store = _fresh(spark, "threats"), _fresh(spark, "incidents"), _fresh(spark, "store")
    SH.write_threat_sheet(T.whole_catalog(spark, d), thr)
    SH.write_incident_sheet(T.incidents_ev(spark, d), inc)
    ingest.load(spark, thr, inc, store).collect()                        # two rows
    return ingest.load(spark, thr, inc, store)


@register("s18_s03_partitioned_roundtrip", q("SELECT * FROM incidents_li", cal=False), "S18", "S03")
def s18(spark, d):
    path = _fresh(spark, "incident-table")
    SK.write_incident_table(T.incidents_li(spark, d), path)
    return SK.read_incident_table(spark, path)


@register("s19_load_audit", q("""SELECT 'threats' AS "table", count(*) AS rows FROM (
      SELECT threat_id FROM whole_catalog UNION SELECT threat_id FROM catalog_revision)
    UNION ALL SELECT 'incidents', count(*) FROM (SELECT DISTINCT enterprise_code, incident_time FROM incidents_li)""",
    src="whole_catalog", cal=False, views=("catalog_revision", "incidents_li")), "S19", "S14", "S15")
def s19(spark, d):
    thr = upsert_last_wins([T.whole_catalog(spark, d), T.catalog_revision(spark, d)], ["threat_id"], [])
    inc = upsert_last_wins([T.incidents_li(spark, d)], ["enterprise_code", "incident_time"], _LI_ORDER)
    return SK.load_audit(threats=thr, incidents=inc)


@register("s04_threat_read", q("SELECT threat_id, name FROM all_threats", src="all_threats", cal=False), "S04", "S05")
def s04(spark, d):
    return T.all_threats(spark, d)


@register("s11_missing_time_column", q("""SELECT enterprise_type, enterprise_code, host_count, threat_code, success,
    region, incident_date, TIMESTAMP '2024-08-12 11:00:00' AS incident_time FROM incidents_ev""",
    src="incidents_ev", cal=False), "S11", "S02", "S06")
def s11(spark, d):
    path = _fresh(spark, "incident-sheet-no-time")
    SH.write_incident_sheet(T.incidents_ev(spark, d), path)
    raw = spark.read.option("header", "true").csv(path).drop("Региональное время")
    path2 = _fresh(spark, "incident-sheet-no-time")
    raw.write.option("header", "true").csv(path2)
    return SH.read_incident_sheet(spark, path2)


@register("s12_zone_to_naive_utc", q("""SELECT incident_id, incident_time - INTERVAL 3 HOUR AS naive_utc
    FROM incidents_ev""", src="incidents_ev", cal=False), "S12")
def s12(spark, d):
    inc = T.incidents_ev(spark, d)
    # Zone-aware instants: the wall clock is Moscow time (UTC+3 all year since 2014).
    aware = F.convert_timezone(F.lit("Europe/Moscow"), F.current_timezone(), F.col("incident_time")).cast("timestamp")
    return inc.select("incident_id", C.naive_utc(aware).alias("naive_utc"))
