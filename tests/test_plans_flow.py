"""End-to-end flows: the load command (sheets → upsert → snapshot) and the dashboard frames."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.plans import dashboard, ingest
from riskloom.session import scratch_path
from riskloom.sources import sheets as SH
from riskloom.sources import tables as T
from riskloom.streaming.jobs import fresh


def test_load_is_idempotent_and_upserts(spark):
    thr_sheet, inc_sheet = fresh(spark, "thr"), fresh(spark, "inc")
    SH.write_threat_sheet(T.threat_catalog(spark, SF_SMALL), thr_sheet)
    SH.write_incident_sheet(T.incidents_li(spark, SF_SMALL), inc_sheet)
    store = scratch_path(spark, "store-" + thr_sheet[-6:])
    first = {r.table: r.rows for r in ingest.load(spark, thr_sheet, inc_sheet, store).collect()}
    again = {r.table: r.rows for r in ingest.load(spark, thr_sheet, inc_sheet, store).collect()}
    assert first == again
    want = T.incidents_li(spark, SF_SMALL).select("enterprise_code", "incident_time").distinct().count()
    assert first["incidents"] == want
    rev_sheet = fresh(spark, "rev")
    SH.write_threat_sheet(T.catalog_revision(spark, SF_SMALL), rev_sheet)
    third = {r.table: r.rows for r in ingest.load(spark, rev_sheet, inc_sheet, store).collect()}
    ids = T.threat_catalog(spark, SF_SMALL).select("threat_id").union(
        T.catalog_revision(spark, SF_SMALL).select("threat_id")).distinct().count()
    assert third["threats"] == ids
    thr, _ = ingest.tables(spark, store)
    revised = thr.where(F.col("name").endswith(" (rev)")).count()
    assert revised == T.catalog_revision(spark, SF_SMALL).count()


def test_dashboard_frames(spark):
    inc = T.incidents_ev(spark, SF_SMALL)
    thr = T.threats(spark, SF_SMALL)
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    fr = dashboard.frames(inc, thr, types=["BUILDING"], mode="success", as_of=as_of)
    kpi = fr["kpis"].first()
    want = inc.where((F.col("enterprise_type") == "BUILDING") & (F.col("success") == 1)).count()
    assert kpi.incidents == want and kpi.enterprise_types == 1
    assert sum(r.n for r in fr["by_hour"].collect()) == want
    assert fr["weekday_hour"].count() <= 7
    assert fr["alert"].count() == 1
