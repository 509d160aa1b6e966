"""Hand-made edge rows for the semantic decisions of SURVEY §1.3 (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import calendar as cal
from riskloom.functions import casts as C
from riskloom.functions import text as tx
from riskloom.ml import encode as EN
from riskloom.operators import aggregates as A
from riskloom.operators import enrich as E
from riskloom.operators import pivots as V
from riskloom.operators import topk as W
from riskloom.sources.upsert import upsert_last_wins
from riskloom.streaming import alerts as AL

INC = ("incident_id bigint, enterprise_type string, enterprise_code string, host_count int, threat_code int, "
       "success int, region string, incident_date date, incident_time timestamp_ntz")


def inc_rows(spark, rows):
    return spark.createDataFrame(rows, INC)


def t(s):
    return dt.datetime.fromisoformat(s)


def test_calendar_and_flags(spark):
    times = ["2024-01-01 05:00:00", "2024-01-06 06:00:00", "2024-01-07 08:00:00", "2024-03-05 09:00:00",
             "2024-06-05 18:00:00", "2024-09-05 19:00:00", "2024-12-05 21:00:00", "2024-11-05 22:00:00"]
    df = spark.createDataFrame([(i, t(x)) for i, x in enumerate(times)], "i int, incident_time timestamp_ntz")
    out = cal.with_time_flags(cal.with_calendar(df)).orderBy("i").collect()
    assert [r.hour for r in out] == [5, 6, 8, 9, 18, 19, 21, 22]
    assert [r.dow for r in out][:3] == [0, 5, 6]                         # D3: Monday = 0
    assert [r.is_weekend for r in out][:3] == [0, 1, 1]
    assert [r.night_attack for r in out] == [1, 0, 0, 0, 0, 0, 0, 1]     # D23
    assert [r.working_hours for r in out] == [0, 0, 0, 1, 1, 0, 0, 0]
    assert [r.season for r in out] == [K.SEASON_WINTER] * 3 + [K.SEASON_SPRING, K.SEASON_SUMMER,
                                                               K.SEASON_AUTUMN, K.SEASON_WINTER, K.SEASON_AUTUMN]


def test_null_time(spark):
    df = spark.createDataFrame([(None,)], "incident_time timestamp_ntz")
    plain = cal.with_calendar(df).first()
    assert plain.month is None and plain.season == K.SEASON_AUTUMN       # D1: null falls to autumn
    filled = cal.with_calendar(df, fill_missing=True).first()
    assert (filled.hour, filled.dow, filled.month, filled.season) == (0, 0, 1, K.SEASON_WINTER)   # P05


def test_weekday_names(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "dow int")
    assert [r[0] for r in df.select(cal.weekday_name("dow")).collect()] == list(K.WEEKDAY_SHORT)


def test_lenient_cast(spark):
    df = spark.createDataFrame([("abc",), ("12.7",), (None,), (" 7 ",)], "x string")
    assert [r[0] for r in df.select(C.lenient_int("x")).collect()] == [0, 12, 0, 7]     # D10


def test_breach_flag(spark):
    df = spark.createDataFrame([("0",), ("1",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(C.truthy("x")).collect()] == [False, True, True, True]   # D8


def test_dayfirst_parse(spark):
    df = spark.createDataFrame([("12.08.2024 11:00",), ("zz",), ("01.02.2024",)], "x string")
    got = [r[0] for r in df.select(C.parse_dayfirst("x")).collect()]
    assert got == [t("2024-08-12 11:00:00"), None, t("2024-02-01 00:00:00")]


def test_truncate_and_display(spark):
    df = spark.createDataFrame([("x" * 50,), ("y" * 51,), (None,)], "s string")
    got = [r[0] for r in df.select(tx.truncate("s", 50)).collect()]
    assert got == ["x" * 50, "y" * 50 + "...", ""]


def test_orphan_threat_kept_and_not_ranked(spark):
    rows = [(1, "A", "1", 1, 7, 1, "R", None, None), (2, "A", "2", 1, 99, 0, "R", None, None)]
    inc = inc_rows(spark, rows)
    thr = spark.createDataFrame([(7, "seven")], "threat_id int, name string")
    joined = E.join_threat_names(inc, thr).orderBy("incident_id").collect()
    assert [r.threat_name for r in joined] == ["seven", None]           # J01 keeps the orphan
    top = W.top_k_by_count(E.join_threat_names(inc, thr), "threat_name").collect()
    assert [r.threat_name for r in top] == ["seven"]                    # D4: null group dropped


def test_ties_smaller_key_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string")
    assert [r.k for r in W.top_k_by_count(df, "k", 3).collect()] == ["c", "a", "b"]     # D5
    rates = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.1)], "hour int, success_rate double")
    assert W.arg_max(rates, "hour", "success_rate").first().hour == 1


def test_min_support(spark):
    rows = []
    i = 0
    for name, n in (("g4", 4), ("g5", 5), ("g9", 9), ("g10", 10)):
        for _ in range(n):
            i += 1
            rows.append((i, name))
    df = spark.createDataFrame(rows, "incident_id int, enterprise_type string").withColumn("success", F.lit(1))
    five = A.rate_and_count_by(df, "enterprise_type", min_support=5).collect()
    assert sorted(r.enterprise_type for r in five) == ["g10", "g5", "g9"]
    named = df.withColumnRenamed("enterprise_type", "threat_name")
    assert sorted(r.threat_name for r in A.threat_success(named).collect()) == ["g10"]


def test_unseen_category_code_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    vocab = EN.vocabulary(train, "x")
    assert {r.value: r.code for r in vocab.collect()} == {"a": 0, "b": 1, "c": 2}
    new = spark.createDataFrame([("c",), ("zz",), (None,)], "x string")
    assert [r.x_enc for r in EN.apply_codes(new, "x", vocab).collect()] == [2, 0, 0]   # D16


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, d double")
    sc = EN.PopulationScaler.fit(df, ["c", "d"])
    out = sc.transform(df).collect()
    assert [r.c_z for r in out] == [0.0, 0.0]
    assert sorted(r.d_z for r in out) == [-1.0, 1.0]                     # population std (D17)


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "old", 10), (2, "keep", 20)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "mid", 1), (1, "new", 2)], "k int, v string, seq int")
    out = {r.k: r.v for r in upsert_last_wins([old, new], ["k"], ["seq"]).collect()}
    assert out == {1: "new", 2: "keep"}


def test_recency_boundaries(spark):
    as_of = t("2024-01-10 12:00:00")
    rows = [(1, "A", "1", 1, 1, 1, "R", None, as_of - dt.timedelta(seconds=5)),
            (2, "A", "1", 1, 1, 1, "R", None, as_of - dt.timedelta(seconds=4.999)),
            (3, "B", "1", 1, 1, 1, "S", None, as_of + dt.timedelta(hours=1))]
    df = inc_rows(spark, rows)
    got = sorted(r.incident_id for r in AL.recent_rows(df, F.lit(as_of)).collect())
    assert got == [2, 3]                                                 # strict, no upper bound (D20)
    last = AL.latest_attack(df, F.lit(as_of)).first()
    assert last.attack and last.incident_id == 3 and last.text == K.ALERT_PREFIX + "B" + K.ALERT_REGION + "S"
    none = AL.latest_attack(df, F.lit(as_of + dt.timedelta(days=1))).first()
    assert (none.attack, none.text) == (False, K.NO_EVENTS)
    empty = AL.latest_attack(df.limit(0), F.lit(as_of)).first()
    assert (empty.attack, empty.text) == (False, K.NO_DATA)


def _latch_input(spark, seconds, region="R"):
    base = t("2024-01-01 00:00:00")
    rows = [(i, "T", "1", 1, 1, 1, region, None, base + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return inc_rows(spark, rows)


def test_latch_fires_at_0_and_300(spark):
    df = _latch_input(spark, [0, 299, 300])
    got = sorted(r.incident_id for r in AL.latch_alerts(df).collect())
    assert got == [0, 2]                                                 # D21
    hourly = sorted(r.incident_id for r in AL.latch_alerts(df, max_group_rows=1).collect())
    assert hourly == [0, 2]


def test_month_pivot_missing_month_is_null(spark):
    df = spark.createDataFrame([(1, "зима", 1), (2, "зима", 0)], "month int, season string, success int")
    row = V.season_month_rate(df).first()
    assert (row.m01, row.m02, row.m04) == (1.0, 0.0, None)               # D7


def test_zone_handling_independent_of_session_zone(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = {}
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            rows = entry.queries()["s12_zone_to_naive_utc"](spark, SF_SMALL).orderBy("incident_id").limit(50).collect()
            parsed = spark.createDataFrame([("12.08.2024 11:00",)], "x string").select(C.parse_dayfirst("x")).first()[0]
            got[tz] = (rows, parsed)
        assert got["UTC"] == got["America/New_York"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_day_first_format_padding(spark):
    from riskloom.functions.wallclock import fmt_day_first
    df = spark.createDataFrame([(dt.date(5, 3, 4), t("0005-03-04T07:08:09")), (dt.date(2024, 12, 31), t("2024-12-31T23:59:00")),
                                (None, None)], "d date, ts timestamp_ntz")
    got = [tuple(r) for r in df.select(tx.fmt_date("d"), tx.fmt_datetime("ts"), fmt_day_first("ts", seconds=True)).collect()]
    assert got == [("04.03.0005", "04.03.0005 07:08", "04.03.0005 07:08:09"),
                   ("31.12.2024", "31.12.2024 23:59", "31.12.2024 23:59:00"), ("", "", None)]
