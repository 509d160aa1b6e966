"""Registered queries for the alert and the streaming jobs.

Stream queries replay a driver table as a file stream (several steps
in event-time order, each drained with ``availableNow``) and return what the sink holds; their
oracle is the same SQL as the batch twin, so stream = batch is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.wallclock import ntz_lit
from riskloom.ml import score as SC
from riskloom.operators.filters import dashboard_filter
from riskloom.plans import analysis as AN
from riskloom.plans.registry import register
from riskloom.plans.sqltext import q
from riskloom.sources import tables as T
from riskloom.streaming import alerts as AL
from riskloom.streaming import jobs as J
from riskloom.streaming import latch as LT

CHUNKS = 4

def _t01_sql(filtered: bool) -> str:
    where = "WHERE enterprise_type IN ('BUILDING', 'MACHINERY') AND success = 1" if filtered else ""
    return q(f"""SELECT r.incident_id IS NOT NULL AS attack,
    CASE WHEN (SELECT count(*) FROM src) = 0 THEN '{K.NO_DATA}'
         WHEN r.incident_id IS NULL THEN '{K.NO_EVENTS}'
         ELSE '{K.ALERT_PREFIX}' || r.enterprise_type || '{K.ALERT_REGION}' || r.region END AS text,
    r.incident_id, r.incident_time
    FROM (SELECT 1 AS one) d LEFT JOIN (
      SELECT * FROM src WHERE incident_time > (SELECT max(incident_time) FROM incidents_ev) - INTERVAL 5 SECOND
      ORDER BY incident_time DESC, incident_id DESC LIMIT 1) r ON true""",
             src="incidents_ev", cal=False, ctes=(f"src AS (SELECT * FROM incidents_ev {where})",))


def _as_of(inc):
    return ntz_lit(inc.agg(F.max("incident_time")).first()[0])    # the dashboard's "now": one scalar


@register("t01_recent_attack_latest", _t01_sql(False), "T01", "F04", "W12", "P24")
def t01(spark, d):
    inc = T.incidents_ev(spark, d)
    return AL.latest_attack(inc, _as_of(inc))


@register("t01_recent_attack_filtered", _t01_sql(True), "T01", "F01", "F02", "F03", "F04")
def t01_filtered(spark, d):
    inc = T.incidents_ev(spark, d)
    view = dashboard_filter(inc, types=("BUILDING", "MACHINERY"), mode="success")
    return AL.latest_attack(view, _as_of(inc))


_LATCH_SQL = q(f"""SELECT c.region, c.t AS alert_time, f.incident_id, e.enterprise_type,
    '{K.ALERT_PREFIX}' || e.enterprise_type || '{K.ALERT_REGION}' || c.region AS alert_text
    FROM chain c JOIN firsts f ON f.region = c.region AND f.t = c.t
    JOIN ev e ON e.incident_id = f.incident_id""", src="incidents_ev", cal=False, recursive=True, ctes=(
    "ev AS (SELECT region, incident_time AS t, incident_id, enterprise_type FROM incidents_ev "
    "WHERE incident_time IS NOT NULL)",
    "firsts AS (SELECT region, t, min(incident_id) AS incident_id FROM ev GROUP BY region, t)",
    "nx AS (SELECT f.region, f.t, (SELECT min(e2.t) FROM ev e2 WHERE e2.region = f.region "
    "AND e2.t >= f.t + INTERVAL 300 SECOND) AS nt FROM firsts f)",
    "chain(region, t) AS (SELECT region, min(t) FROM ev GROUP BY region UNION ALL "
    "SELECT n.region, n.nt FROM chain c JOIN nx n ON n.region = c.region AND n.t = c.t WHERE n.nt IS NOT NULL)",
))


@register("t02_alert_latch_batch", _LATCH_SQL, "T02", "P24")
def t02(spark, d):
    return AL.latch_alerts(T.incidents_ev(spark, d))


@register("t02_alert_latch_stream", _LATCH_SQL, "T02", "S17", "S16")
def t02_stream(spark, d):
    src, sink, ck = J.fresh(spark, "events-src"), J.fresh(spark, "alerts-sink"), J.fresh(spark, "alerts-ckpt")
    state = J.fresh(spark, "alerts-state")
    J.replay(T.table(spark, d, "events"), src, lambda: LT.run(J.incident_stream(spark, src, d), sink, state, ck), chunks=CHUNKS)
    LT.flush(spark, sink, state)
    return J.read_sink(spark, sink).drop("batch_id")


@register("t02_alert_latch_one_region", _LATCH_SQL.replace("SELECT region, incident_time AS t", "SELECT 'all' AS region, incident_time AS t"),
          "T02", "S17", "S16")
def t02_one_region(spark, d):
    """The stream with all events in one region, each replay step in two halves of which the later comes first."""
    src, sink, ck = J.fresh(spark, "events-src"), J.fresh(spark, "alerts-sink"), J.fresh(spark, "alerts-ckpt")
    state, events = J.fresh(spark, "alerts-state"), T.table(spark, d, "events")
    whole = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = (whole["hi"] - whole["lo"]).total_seconds() if whole["lo"] else 0
    # Steps 2, 1, 4, 3 of four: out of order by up to half the whole span, which the delay covers.
    step = F.floor(F.timestamp_diff("MICROSECOND", ntz_lit(whole["lo"]), F.col("ts").cast("timestamp_ntz"))
                   * F.lit(4) / F.lit(span * 1_000_000 + 1)) if span else F.lit(0)
    for i in (1, 0, 3, 2):
        events.where(step == i).write.mode("append").parquet(src)
        LT.run(J.incident_stream(spark, src, d).withColumn("region", F.lit("all")), sink, state, ck, delay_seconds=int(span / 2) + 1)
    LT.flush(spark, sink, state)
    return J.read_sink(spark, sink).drop("batch_id")


@register("t03_stream_kpis", q("""SELECT count(*) AS incidents, count(DISTINCT enterprise_type) AS enterprise_types,
    count(DISTINCT region) AS regions, count(DISTINCT threat_code) AS threat_codes,
    avg(success) * 100 AS success_pct, avg(host_count) AS mean_hosts FROM incidents_ev""",
    src="incidents_ev", cal=False), "T03", "A02", "S17")
def t03(spark, d):
    src, sink, ck = J.fresh(spark, "events-src"), J.fresh(spark, "kpi-sink"), J.fresh(spark, "kpi-ckpt")
    J.replay(T.table(spark, d, "events"), src, lambda: J.run_to_sink(
        J.kpi_stream(J.incident_stream(spark, src, d)), sink, ck, mode="update"), chunks=CHUNKS)
    return J.kpis(spark, sink)


@register("t03_stream_region_kpis", q("""SELECT region, count(*) AS incidents, avg(success) * 100 AS success_pct,
    avg(host_count) AS mean_hosts FROM incidents_ev GROUP BY region""", src="incidents_ev", cal=False),
    "T03", "A08")
def t03_region(spark, d):
    src, sink, ck = J.fresh(spark, "events-src"), J.fresh(spark, "rkpi-sink"), J.fresh(spark, "rkpi-ckpt")
    J.replay(T.table(spark, d, "events"), src, lambda: J.run_to_sink(
        J.region_kpi_stream(J.incident_stream(spark, src, d)), sink, ck, mode="complete"), chunks=CHUNKS)
    return J.latest_batch(spark, sink)


_LI_SCHEMA = ("enterprise_type string, enterprise_code string, host_count int, threat_code int, success int, "
              "region string, incident_date date, incident_time timestamp_ntz")
_LI_ORDER = ["host_count", "threat_code", "success", "enterprise_type", "region", "incident_date"]


@register("t04_stream_upsert_ingest", q("""SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY enterprise_code, incident_time
      ORDER BY host_count DESC, threat_code DESC, success DESC, enterprise_type DESC, region DESC,
               incident_date DESC) AS _rn FROM incidents_li) WHERE _rn = 1""", cal=False), "T04", "S15", "S16", "S17")
def t04(spark, d):
    src, log, ck = J.fresh(spark, "incident-src"), J.fresh(spark, "incident-log"), J.fresh(spark, "ingest-ckpt")
    J.replay(T.incidents_li(spark, d), src, lambda: J.ingest(J.event_stream(spark, src, schema=_LI_SCHEMA), log, ck),
             "incident_time", CHUNKS)
    return J.resolved_incidents(spark, log, ["enterprise_code", "incident_time"], _LI_ORDER)


@register("t05_stream_scoring", None, "T05", "S16", "M27")
def t05(spark, d):
    art = SC.artifacts_from(AN.analysis_for(spark, d, AN.REFERENCE).with_parts("clusters", "success", "threat"))
    src, sink, ck = J.fresh(spark, "events-src"), J.fresh(spark, "generated-sink"), J.fresh(spark, "score-ckpt")

    def generate(batch):
        return SC.score(batch, art).select(
            F.col("incident_id").alias("source_incident_id"), F.current_timestamp().alias("generated_at"),
            F.col("success_probability").alias("confidence"), "cluster", "predicted_threat")
    J.replay(T.table(spark, d, "events"), src, lambda: J.run_to_sink(
        J.incident_stream(spark, src, d), sink, ck, transform=generate), chunks=CHUNKS)
    return J.read_sink(spark, sink)

