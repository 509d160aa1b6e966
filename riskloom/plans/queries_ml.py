"""Registered queries for the ML operators and reports.

Deterministic operators (vocabularies, one-hot, scaling, split, weights,
rankings) carry a DuckDB oracle.  Fitted models (k-means, trees, PCA) have no
SQL equivalent; their queries share one analysis run per session (the
reference's full profile: ten restarts, 300 iterations, 200 and 300 rounds) and are
checked by invariants in ``tests/``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import calendar as cal
from riskloom.functions.text import forecast_card, join_key
from riskloom.ml import classify as CF
from riskloom.ml import cluster as CL
from riskloom.ml import encode as EN
from riskloom.ml import explain as XP
from riskloom.ml import metrics as MT
from riskloom.ml import score as SC
from riskloom.ml.split import balanced_weight, positive_weight, stratified_split
from riskloom.operators import enrich as E
from riskloom.operators.topk import sample_one
from riskloom.plans import analysis as AN
from riskloom.plans import report as R
from riskloom.plans.registry import register
from riskloom.plans.sqltext import q
from riskloom.session import reliable_checkpoint, scratch_path
from riskloom.sources import tables as T

IDS = AN.LI_ID_COLS
_IDS_SQL = ", ".join(IDS)
_MD5 = "md5(concat_ws('|', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in IDS) + "))"


# ----------------------------------------------------------------- encoding

def _vocab_sql(col):
    return (f"SELECT '{col}' AS column_name, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code "
            f"FROM (SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), 'None') AS value FROM feat)")


@register("m01_label_vocabularies", q(" UNION ALL ".join(_vocab_sql(c) for c in CL.CAT_COLS), feat=True), "M01")
def m01(spark, d):
    return EN.vocabularies(E.categorical_frame(T.incidents_li(spark, d)), CL.CAT_COLS)


@register("j04_vocab_lookup_unseen", q("""SELECT e.incident_id,
    coalesce(v1.code, 0) AS enterprise_type_enc, coalesce(v2.code, 0) AS industry_threat_enc
    FROM ev e
    LEFT JOIN (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT coalesce(enterprise_type, 'None') AS value FROM feat)) v1
      ON v1.value = e.enterprise_type
    LEFT JOIN (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT industry_threat AS value FROM feat)) v2
      ON v2.value = e.industry_threat""", feat=True, views=("incidents_ev",),
    ctes=("ev AS (SELECT incident_id, enterprise_type, "
          "coalesce(enterprise_type, 'None') || '_' || coalesce(CAST(threat_code AS VARCHAR), 'None') "
          "AS industry_threat FROM incidents_ev)",)), "J04", "M01", "P11")
def j04(spark, d):
    voc = reliable_checkpoint(EN.vocabularies(E.categorical_frame(T.incidents_li(spark, d)),
                                              ["enterprise_type", "industry_threat"]))
    ev = T.incidents_ev(spark, d).select("incident_id", "enterprise_type",
                                         join_key("enterprise_type", "threat_code").alias("industry_threat"))
    for c in ("enterprise_type", "industry_threat"):
        ev = EN.apply_codes(ev, c, voc.where(F.col("column_name") == c).select("value", "code"))
    return ev.select("incident_id", "enterprise_type_enc", "industry_threat_enc")


_OHE_SQL = q("""SELECT enterprise_code, incident_time,
    CAST(enterprise_type = 'BUILDING' AS INTEGER) AS enterprise_type_BUILDING,
    CAST(enterprise_type = 'FURNITURE' AS INTEGER) AS enterprise_type_FURNITURE,
    CAST(enterprise_type = 'HOUSEHOLD' AS INTEGER) AS enterprise_type_HOUSEHOLD,
    CAST(enterprise_type = 'MACHINERY' AS INTEGER) AS enterprise_type_MACHINERY,
    CAST(season = 'зима' AS INTEGER) AS "season_зима", CAST(season = 'лето' AS INTEGER) AS "season_лето",
    CAST(season = 'осень' AS INTEGER) AS "season_осень" FROM cal""")


@register("m02_one_hot_drop_first", _OHE_SQL, "M02")
def m02(spark, d):
    df = cal.with_calendar(T.incidents_li(spark, d))
    cols = []
    for c in ("enterprise_type", "season"):
        levels = EN.category_levels(df, c)
        df = EN.one_hot(df, c, levels)
        cols += [EN.dummy_name(c, lv) for lv in levels[1:]]
    return df.select("enterprise_code", "incident_time", *cols)


_Z = ("host_count", "hour", "dow", "month")


@register("m03_population_zscores", q("SELECT enterprise_code, incident_time, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 9) + 0.0 AS {c}_z" for c in _Z)
    + " FROM cal"), "M03", "A19")
def m03(spark, d):
    df = cal.with_calendar(T.incidents_li(spark, d))
    sc = EN.PopulationScaler.fit(df, list(_Z))
    return df.select("enterprise_code", "incident_time", *[F.round(sc.column(c), 9).alias(f"{c}_z") for c in _Z])


# ----------------------------------------------------------------- split and weights

def _kept(df, name):
    """``df`` as a written table in the shared checkpoint folder."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SPLIT_CTE = (f"split AS (SELECT {_IDS_SQL}, row_number() OVER (PARTITION BY success ORDER BY {_MD5}, {_IDS_SQL}) "
              f"<= ceil(0.2 * count(*) OVER (PARTITION BY success)) AS is_test FROM incidents_li)")


@register("m11_stratified_split", q(f"SELECT {_IDS_SQL}, is_test FROM split", cal=False, ctes=(_SPLIT_CTE,)), "M11")
def m11(spark, d):
    return stratified_split(T.incidents_li(spark, d).select(*IDS), "success", IDS)


@register("m12_positive_class_weight", q("""SELECT CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
    CAST(sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
    round(CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN success = 1 THEN 1 ELSE 0 END), 9)
      AS scale_pos_weight,
    round(sum(CASE WHEN success = 1 THEN CAST(sum_neg AS DOUBLE) / sum_pos ELSE 1.0 END), 6) AS weight_sum
    FROM (SELECT *, sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) OVER () AS sum_neg,
                 sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) OVER () AS sum_pos FROM split WHERE NOT is_test)""",
    cal=False, ctes=(_SPLIT_CTE,)), "M12", "A17")
def m12(spark, d):
    data = stratified_split(T.incidents_li(spark, d).select(*IDS), "success", IDS)
    # The split is made once: the ratio and the sums below read its labels.
    train, ratio = positive_weight(_kept(data.where(~F.col("is_test")).select("success"), "train-labels"), "success")
    return train.agg(F.sum((F.col("success") == 0).cast("int")).cast("bigint").alias("n_neg"),
                     F.sum((F.col("success") == 1).cast("int")).cast("bigint").alias("n_pos"),
                     F.round(F.lit(ratio), 9).alias("scale_pos_weight"),
                     F.round(F.sum("weight"), 6).alias("weight_sum"))


_THREAT_CTES = (
    "top AS (SELECT threat_code FROM incidents_li WHERE threat_code IS NOT NULL GROUP BY threat_code "
    "ORDER BY count(*) DESC, threat_code LIMIT 10)",
    "classes AS (SELECT threat_code, CAST(row_number() OVER (ORDER BY threat_code) - 1 AS INTEGER) AS class_code "
    "FROM top)",
    f"tsplit AS (SELECT *, row_number() OVER (PARTITION BY class_code ORDER BY {_MD5}, {_IDS_SQL}) "
    "<= ceil(0.2 * count(*) OVER (PARTITION BY class_code)) AS is_test "
    "FROM incidents_li JOIN classes USING (threat_code))",
)


@register("m20_threat_classes", q("SELECT threat_code, class_code FROM classes", cal=False, ctes=_THREAT_CTES[:2]),
          "M20", "M01", "W07")
def m20(spark, d):
    _, classes = CF.threat_subset(T.incidents_li(spark, d))
    return classes


@register("m13_balanced_weights", q("""SELECT class_code, count(*) AS n_c,
    round(CAST((SELECT count(*) FROM tsplit WHERE NOT is_test) AS DOUBLE)
      / ((SELECT count(DISTINCT class_code) FROM tsplit WHERE NOT is_test) * count(*)), 9) AS weight
    FROM tsplit WHERE NOT is_test GROUP BY class_code""", cal=False, ctes=_THREAT_CTES), "M13", "M11", "M20")
def m13(spark, d):
    sub, _ = CF.threat_subset(T.incidents_li(spark, d).select(*IDS))
    # Split and weights read the rows several times: those of the commonest threats are picked once.
    data = stratified_split(_kept(sub, "threat-rows"), "class_code", IDS)
    train = balanced_weight(data.where(~F.col("is_test")), "class_code")
    return train.groupBy("class_code").agg(F.count(F.lit(1)).alias("n_c"), F.round(F.first("weight"), 9).alias("weight"))


# ----------------------------------------------------------------- reports

_RECS_CTE = """recs AS (
    (SELECT 'peak_hour' AS topic, 1 AS rank, CAST(hour AS VARCHAR) AS value FROM cal GROUP BY hour
       ORDER BY avg(success) DESC, hour LIMIT 1)
    UNION ALL (SELECT 'peak_dow', 1, CAST(dow AS VARCHAR) FROM cal GROUP BY dow ORDER BY avg(success) DESC, dow LIMIT 1)
    UNION ALL (SELECT 'peak_month', 1, CAST(month AS VARCHAR) FROM cal GROUP BY month
       ORDER BY avg(success) DESC, month LIMIT 1)
    UNION ALL (SELECT 'industry', CAST(row_number() OVER (ORDER BY avg(success) DESC, enterprise_type) AS INTEGER),
       enterprise_type FROM cal GROUP BY enterprise_type ORDER BY avg(success) DESC, enterprise_type LIMIT 3)
    UNION ALL (SELECT 'region', CAST(row_number() OVER (ORDER BY avg(success) DESC, region) AS INTEGER), region
       FROM cal GROUP BY region ORDER BY avg(success) DESC, region LIMIT 3)
    UNION ALL (SELECT 'threat', rk, threat_name FROM (
       SELECT t.name AS threat_name, CAST(row_number() OVER (ORDER BY avg(c.success) DESC, t.name) AS INTEGER) AS rk
       FROM cal c JOIN threats t ON t.threat_id = c.threat_code GROUP BY t.name HAVING count(*) >= 10) WHERE rk <= 5))"""


def _recs(spark, d):
    return R.recommendations(cal.with_calendar(T.incidents_li(spark, d)), T.threats(spark, d))


@register("r02_recommendations", q("SELECT topic, rank, value FROM recs", views=("threats",), ctes=(_RECS_CTE,)),
          "R02", "W08", "W09", "A07", "A08", "A09")
def r02(spark, d):
    return _recs(spark, d)


def _list_sql(topic):
    return (f"(SELECT '[' || string_agg('''' || value || '''', ', ' ORDER BY rank) || ']' FROM recs "
            f"WHERE topic = '{topic}')")


def _tpl(t, **kw):
    for k, v in kw.items():
        t = t.replace("{" + k + "}", "' || " + v + " || '")
    return "'" + t + "'"


_LINES_SQL = q(f"""SELECT 1 AS line_no, {_tpl(K.REC_TIME, hour="(SELECT value FROM recs WHERE topic = 'peak_hour')",
                                              dow="(SELECT value FROM recs WHERE topic = 'peak_dow')",
                                              month="(SELECT value FROM recs WHERE topic = 'peak_month')")} AS line
    UNION ALL SELECT 2, {_tpl(K.REC_INDUSTRY, items=_list_sql('industry'))}
    UNION ALL SELECT 3, {_tpl(K.REC_REGION, items=_list_sql('region'))}
    UNION ALL SELECT 4, {_tpl(K.REC_THREAT, items=_list_sql('threat'))}
    UNION ALL SELECT 7, '{K.REC_ARCH}'""", views=("threats",), ctes=(_RECS_CTE,))


@register("r02_recommendation_lines", _LINES_SQL, "R02", "W09")
def r02_lines(spark, d):
    return R.recommendation_lines(_recs(spark, d))


@register("s21_overview_metrics", q("""SELECT 'overview' AS section, 'incidents' AS metric, CAST(count(*) AS DOUBLE) AS value
    FROM incidents_li UNION ALL SELECT 'overview', 'successes', CAST(sum(success) AS DOUBLE) FROM incidents_li
    UNION ALL SELECT 'overview', 'success_pct', avg(success) * 100 FROM incidents_li""", cal=False), "S21", "A01")
def s21(spark, d):
    return AN.overview_metrics(T.incidents_li(spark, d))


# ----------------------------------------------------------------- fitted models (rows-only)

def _an(spark, d):
    return AN.analysis_for(spark, d, AN.REFERENCE)


@register("m06_m07_k_sweep", None, "M04", "M05", "M06", "M07")
def m06(spark, d):
    return AN.sweep_table(spark, _an(spark, d))


@register("m05_m08_cluster_sizes", None, "M05", "M08")
def m05(spark, d):
    return _an(spark, d).frame.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("m09_pca_projection", None, "M09")
def m09(spark, d):
    return _an(spark, d).projection[0].select(*IDS, F.round("pca1", 9).alias("pca1"), F.round("pca2", 9).alias("pca2"))


@register("a14_cluster_profile", None, "A14", "J03")
def a14(spark, d):
    return CL.profile(_an(spark, d).frame)


@register("a15_cluster_risk", None, "A15")
def a15(spark, d):
    return CL.risk(_an(spark, d).frame)


@register("m14_m23_model_comparison", None, "M14", "M17", "M18", "M21", "M22", "M23", "M25", "R03", "S21")
def m14(spark, d):
    a = _an(spark, d).with_parts("clusters", "success", "threat")
    return AN.overview_metrics(a.frame).unionByName(AN.model_comparison(spark, a))


@register("m15_m16_feature_importances", None, "M10", "M15", "M16", "A18")
def m15(spark, d):
    s = _an(spark, d).success
    base = CF.importances(spark, s.baseline, s.features)
    return base.withColumn("selected", F.col("feature").isin(*s.selected))


@register("m19_classification_report", None, "M19")
def m19(spark, d):
    return MT.classification_report(_an(spark, d).success.test_predictions)


@register("m24_threat_probabilities", None, "M24", "M21", "M22")
def m24(spark, d):
    t = _an(spark, d).threat
    return t.test_scored.select("threat_code", "class_code", "prediction", "probs")


def _class_counts(scored):
    """Test rows of each class and what their class probabilities add up to: one for each row."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy("class_code").agg(F.count(F.lit(1)).alias("n_test"), F.round(F.sum(total), 6).alias("probability"))


@register("m21_m22_boosted_threat_counts", q("""SELECT class_code, count(*) AS n_test, CAST(count(*) AS DOUBLE) AS probability
    FROM tsplit WHERE is_test GROUP BY class_code""", cal=False, ctes=_THREAT_CTES), "M21", "M22", "M24", "M11")
def m21_counts(spark, d):
    return _class_counts(_an(spark, d).threat.test_scored)


@register("m21_m22_boosted_threat_reference", None, "M21", "M22", "M23", "M25")
def m21_reference(spark, d):
    """The threat model with all its rounds (200 and 300, D26): test rows and probabilities by class, and its accuracies."""
    frame, columns, _ = CF.model_frame(E.feature_frame(T.incidents_li(spark, d), T.threats(spark, d)))
    t = CF.train_threat(frame, columns, IDS)
    return _class_counts(t.test_scored).withColumns({
        "accuracy_baseline": F.lit(t.acc_baseline), "accuracy_improved": F.lit(t.acc_improved), "top3": F.lit(t.top3),
        "champion": F.lit(t.champion)})


@register("m26_attributions", None, "M26")
def m26(spark, d):
    s = _an(spark, d).success
    test = s.test_predictions
    return XP.summary(test, s.final, s.selected)


def _artifacts(spark, d):
    return SC.artifacts_from(_an(spark, d).with_parts("clusters", "success", "threat"))


@register("m27_m28_batch_scoring", None, "M27", "M28", "P22", "P23", "J04", "M08")
def m27(spark, d):
    scored = SC.score(T.incidents_ev(spark, d), _artifacts(spark, d))
    return scored.select("incident_id", "cluster", "success_probability", "predicted_threat", "threat_probability")


@register("s20_artifact_roundtrip", None, "S20", "M27")
def s20(spark, d):
    path = scratch_path(spark, f"artifacts-{uuid.uuid4().hex[:12]}")
    _artifacts(spark, d).save(path)
    art = SC.Artifacts.load(spark, path)
    scored = SC.score(T.incidents_ev(spark, d), art)
    return scored.select("incident_id", "cluster", "success_probability", "predicted_threat", "threat_probability")


@register("r02_model_lines", None, "R02", "A15", "M15")
def r02_model(spark, d):
    a = _an(spark, d).with_parts("clusters", "success")
    return R.model_lines(CL.risk(a.frame), a.success.importances)


@register("r04_forecast_card", None, "R04", "W13", "P24")
def r04(spark, d):
    scored = SC.score(T.incidents_ev(spark, d), _artifacts(spark, d))
    one = sample_one(scored, K.SPLIT_SEED, ["incident_id"])
    return one.select("incident_id", forecast_card("region", "enterprise_type", "hour", "dow",
                                                   "success_probability").alias("card"))

