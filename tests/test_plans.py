"""Physical-plan properties: pruning, pushdown, no cartesian products, partial aggregation."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_facet_filters_reach_the_scans(spark):
    p = plan(QUERIES["f07_incident_facets"](spark, SF_SMALL))
    assert "(c_mktsegment#" in p and "= BUILDING)" in p                  # customer scan filter
    assert "PushedFilters: [IsNotNull(n_name), EqualTo(n_name,NATION_7)" in p


def test_column_pruning_on_lineitem(spark):
    p = plan(QUERIES["a09_threat_success_min_support"](spark, SF_SMALL))
    line = next(x for x in p.splitlines() if "lineitem.parquet" in x)
    read = line[line.index("ReadSchema"):]
    assert "l_extendedprice" not in read and "l_discount" not in read and "l_tax" not in read


def test_aggregates_combine_partially(spark):
    p = plan(QUERIES["a09_threat_success_min_support"](spark, SF_SMALL))
    assert "partial_sum" in p and "partial_count" in p
    p = plan(QUERIES["a10_industry_pct_min_support"](spark, SF_SMALL))
    assert "partial_avg" in p and "partial_count" in p


@pytest.mark.parametrize("name", ["features_full_frame", "a02_kpi_panel", "s15_incident_upsert",
                                  "m11_stratified_split", "v03_industry_threat_matrix", "t01_recent_attack_latest"])
def test_no_cartesian_product(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_upsert_uses_hash_aggregate_not_sort_window(spark):
    p = plan(QUERIES["s15_incident_upsert"](spark, SF_SMALL))
    assert "max_by" in p and "Window" not in p


def test_pivot_values_are_fixed(spark):
    df = QUERIES["v01_weekday_hour_rate"](spark, SF_SMALL)
    assert df.columns == ["dow"] + [f"h{h:02d}" for h in range(24)]


def test_admin_order_needs_no_single_task(spark):
    plan = entry.queries()["w10_admin_order"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "GlobalLimit 100" not in plan


@pytest.mark.parametrize("copies", [1, 90, 400])
def test_rows_after_the_first_page_with_ties_and_nulls(spark, copies):
    """Rows equal to the page's last row, over several partitions, are neither lost nor given twice."""
    import datetime as dt

    from pyspark.sql import functions as F

    from riskloom.operators import topk as W
    from riskloom.session import reliable_checkpoint
    day = dt.datetime(2024, 1, 5)
    rows = [(day.date(), day, "7", 3, 5, 1, None, "b")] * copies
    rows += [(None if i % 9 == 0 else dt.date(2024, 1, 1 + i % 9), None if i % 4 == 0 else day, str(i % 5),
              None if i % 7 == 0 else i % 7, i % 3, i % 2, "r", "a") for i in range(130)]
    df = spark.createDataFrame(rows, "incident_date date, incident_time timestamp_ntz, enterprise_code string, "
                               "threat_code int, host_count int, success int, region string, enterprise_type string").repartition(5)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(map(tuple, W.default_order(df).offset(100).collect()), key=lambda r: str(key(r)))
    first = reliable_checkpoint(W.default_order(df, page=100))
    assert sorted(map(tuple, W.default_order_after(df, first).collect()), key=lambda r: str(key(r))) == want
    assert W.default_order_after(df.where(F.lit(False)), first.where(F.lit(False))).collect() == []


def ninth_column(spark):
    """Rows that differ only in a column that the default order does not name, and copies of some."""
    import datetime as dt
    day = dt.datetime(2024, 1, 5)
    rows = [(day.date(), day, "7", 3, 5, 1, "r", "b", i if i % 50 else None) for i in range(300)]
    rows += [(day.date(), None if i % 2 else day, "7", 3, i % 3, 1, None, "b", 7) for i in range(200)]
    return spark.createDataFrame(rows, "incident_date date, incident_time timestamp_ntz, enterprise_code string, "
                                 "threat_code int, host_count int, success int, region string, enterprise_type string, "
                                 "incident_id long").repartition(6)


def test_rows_after_the_first_page_keep_their_other_columns(spark):
    from collections import Counter

    from riskloom.operators import topk as W
    df = ninth_column(spark)
    for page in (1, 100, 137, 500):
        first = W.default_order(df, page=page)
        both = list(map(tuple, first.collect())) + list(map(tuple, W.default_order_after(df, first).collect()))
        assert Counter(both) == Counter(map(tuple, df.collect())) and both == list(map(tuple, W.default_order(df).collect()))


def test_positions_over_all_rows(spark):
    from riskloom.operators import paging as PG
    from riskloom.operators import topk as W
    df = ninth_column(spark)
    out = PG.with_position(df, W.DEFAULT_ORDER).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 501))
    assert [tuple(r)[:-1] for r in out] == list(map(tuple, W.default_order(df).collect()))


@pytest.mark.parametrize("size", [1, 7, 64, 600])
def test_pages_by_cursor_make_up_the_whole_order(spark, size):
    from riskloom.operators import paging as PG
    from riskloom.operators import topk as W
    df = ninth_column(spark).where("incident_id IS NULL OR incident_id = 7 OR incident_id < 20").coalesce(2).persist()
    want, got, cursor = list(map(tuple, W.default_order(df).collect())), [], None
    while len(got) < (len(want) if size > 1 else 12):
        page = PG.page_after(df, W.DEFAULT_ORDER, size, cursor).collect()
        assert page
        got += map(tuple, page)
        cursor = PG.cursor_after(page, cursor)
    assert got == want[:len(got)]
    assert size == 1 or PG.page_after(df, W.DEFAULT_ORDER, size, cursor).collect() == []
    df.unpersist()


@pytest.mark.parametrize("name, scans", [("r02_recommendations", 1), ("w08_peak_times", 1), ("f10_date_drilldown", 1),
                                         ("a16_facet_values", 1), ("v03_industry_threat_matrix", 0)])
def test_reports_read_the_incidents_once(spark, name, scans):
    """v03 has read them before its plan is built, into a table of counted pairs."""
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert sum("FileScan parquet" in x and "lineitem.parquet" in x for x in p.splitlines()) == scans


def test_rank_limits_reach_the_tasks(spark):
    p = plan(QUERIES["r02_recommendations"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p[p.index("WindowGroupLimit"):]


def test_crosstab_is_the_pivot_of_the_long_form(spark):
    from riskloom.operators import pivots as V
    from riskloom.sources import tables as T
    inc = T.incidents_ev(spark, SF_SMALL)
    wide, codes = V.industry_threat_matrix(inc, 3)
    long_ = {(r.enterprise_type, r.threat_code): r.n for r in V.industry_threat_long(inc, 3).collect()}
    got = {(r["enterprise_type"], c): r[str(c)] for r in wide.collect() for c in codes}
    assert len(codes) == 3 and {k: n for k, n in got.items() if n} == long_


@pytest.mark.parametrize("most, broadcast", [(1 << 20, True), (100, False)])
def test_broadcast_is_bounded_in_bytes(spark, most, broadcast):
    from riskloom.operators.joins import bounded_broadcast, frame_bytes
    small = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "k int, name string")
    assert frame_bytes(small) == 100 * (16 + 8 + 58)
    p = plan(spark.range(1000).withColumnRenamed("id", "k").join(bounded_broadcast(small, most), "k"))
    assert ("BroadcastHashJoin" in p) == broadcast and ("SortMergeJoin" in p) != broadcast


def test_frequencies_are_broadcast_one_by_one_and_nothing_stays_cached(spark, monkeypatch):
    from riskloom.operators import enrich, joins
    from riskloom.sources import tables as T
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    df = enrich.feature_frame(T.incidents_ev(spark, SF_SMALL), T.threats(spark, SF_SMALL))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached
    whole = plan(df).count("BroadcastHashJoin")
    # a bound that the table of threats passes, and those of regions and industries do not
    monkeypatch.setattr(enrich, "bounded_broadcast", lambda x: joins.bounded_broadcast(x, 2000))
    part = enrich.feature_frame(T.incidents_ev(spark, SF_SMALL), T.threats(spark, SF_SMALL))
    assert plan(part).count("BroadcastHashJoin") == whole - 1
    assert part.count() == df.count()


def test_a_month_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from riskloom.sources import sinks
    day = F.when(F.col("id") % 20 == 0, F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("date")
    rows = spark.range(60000).select(F.lit("T").alias("enterprise_type"), F.sha2(F.col("id").cast("string"), 256).alias("enterprise_code"),
                                     F.lit(1).alias("host_count"), F.lit(1).alias("threat_code"), F.lit(1).alias("success"), F.lit("R").alias("region"),
                                     day.alias("incident_date"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("incident_time"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "512k")
    try:
        sinks.write_incident_table(rows.repartition(4), str(tmp_path / "t"))
    finally:
        spark.conf.set(size, before)
    files = {m: [f for f in os.listdir(tmp_path / "t" / m) if f.startswith("part")] for m in os.listdir(tmp_path / "t") if "=" in m}
    assert len(files["incident_month=2024-01"]) > 2 and sinks.read_incident_table(spark, str(tmp_path / "t")).count() == 60000
