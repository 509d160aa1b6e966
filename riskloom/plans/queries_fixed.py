"""Registered queries of the model operators on deterministic inputs, so that SQL can state their results.

Clusters, centres, predictions, probabilities and trees are fixed by formulas of the columns; everything that
the operators then do with them (profiles, assignment, metrics, selection, scoring, attributions) runs on the whole
tables through the library's own code and is compared with SQL.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import calendar as cal
from riskloom.functions.casts import clean_number
from riskloom.functions.text import forecast_card, title
from riskloom.ml import classify as CF
from riskloom.ml import cluster as CL
from riskloom.ml import encode as EN
from riskloom.ml import explain as XP
from riskloom.ml import metrics as MT
from riskloom.ml import score as SC
from riskloom.ml.boosting import BoostedTrees
from riskloom.operators import enrich as E
from riskloom.plans import report as R
from riskloom.plans.registry import register
from riskloom.plans.sqltext import q
from riskloom.session import reliable_checkpoint, scratch_path
from riskloom.sources import tables as T
from riskloom.streaming import jobs as J


def _li(spark, d):
    return cal.with_calendar(T.incidents_li(spark, d))


# ----------------------------------------------------------------- clusters

def _by_formula(df):
    return df.withColumn("cluster", (F.col("threat_code") % 4).cast("int"))


_CLUSTERED = "clustered AS (SELECT *, CAST(threat_code % 4 AS INTEGER) AS cluster FROM cal)"


@register("a14_profile_of_given_clusters", q("""SELECT cluster, avg(host_count) AS host_count, avg(hour) AS hour, avg(dow) AS dow,
    avg(month) AS month, avg(success) AS success, count(*) AS "count" FROM clustered GROUP BY cluster""", ctes=(_CLUSTERED,)),
    "A14", "J03")
def a14_given(spark, d):
    return CL.profile(_by_formula(_li(spark, d)))


@register("a15_risk_of_given_clusters", q("SELECT cluster, avg(success) AS success_rate FROM clustered GROUP BY cluster",
                                          ctes=(_CLUSTERED,)), "A15")
def a15_given(spark, d):
    return CL.risk(_by_formula(_li(spark, d)))


# Four distinct points: a fit of four clusters on them has them as its centres.
CENTRES = ((3.1, 2.3), (17.7, 5.9), (8.9, 15.2), (41.3, 19.4))


def _centre_model(spark, width: int = 2):
    points = spark.createDataFrame([(Vectors.dense([*c, *[0.0] * (width - 2)]),) for c in CENTRES for _ in range(3)], ["features"])
    return CL.fit_kmeans(points, len(CENTRES), seeds=(42, 43, 44))


def _centre_x(model):
    """The first coordinate of a row's cluster, whose number depends on the fit."""
    return F.element_at(F.array(*[F.lit(round(float(c[0]), 6)) for c in model.clusterCenters()]), F.col("cluster") + 1)


_NEAREST = "(SELECT min_by(cx, (host_count - cx) ** 2 + (hour - cy) ** 2) FROM (VALUES " + ", ".join(
    f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in CENTRES) + ") v(cx, cy))"


@register("m08_assign_to_given_centres", q(f"SELECT incident_id, {_NEAREST} AS centre FROM cal", src="incidents_ev"), "M04", "M05", "M08")
def m08_given(spark, d):
    model = _centre_model(spark)
    rows = VectorAssembler(inputCols=["host_count", "hour"], outputCol="features").transform(
        cal.with_calendar(T.incidents_ev(spark, d)))
    return CL.assign(model, rows).select("incident_id", _centre_x(model).alias("centre"))


@register("m07_choice_of_k", q("""SELECT hour AS k FROM cal WHERE hour BETWEEN 2 AND 10 GROUP BY hour
    ORDER BY avg(success) DESC, hour LIMIT 1"""), "M06", "M07")
def m07_given(spark, d):
    """The choice among nine values of k, with a rate for each of them in the place of its silhouette."""
    rates = _li(spark, d).where(F.col("hour").between(2, 10)).groupBy("hour").agg(F.avg("success").alias("s"), F.count("*").alias("n"))
    table = [(r["hour"], float(r["n"]), r["s"]) for r in rates.collect()]          # nine rows
    return spark.createDataFrame([(CL.SweepResult(table, {}).best_k,)], "k int")


_Z4 = ("host_count", "hour", "dow", "month")


def _scaled(spark, d, cols=_Z4):
    df = _li(spark, d)
    sc = EN.PopulationScaler.fit(df, list(cols))
    return df.select("enterprise_code", "incident_time", "threat_code", *[sc.column(c).alias(c) for c in cols])


@register("m09_covariances", q(" UNION ALL ".join(
    f"SELECT {i} AS row, {j} AS col, round({'1.0::DOUBLE' if i == j else f'corr({_Z4[i]}, {_Z4[j]})'}, 6) + 0.0 AS covariance"
    + (" FROM cal" if i != j else "") for i in range(4) for j in range(i, 4))), "M09", "M03")
def m09_cov(spark, d):
    """Covariances of the scaled columns, which are the columns' correlations."""
    return CL.covariance(_scaled(spark, d), _Z4).withColumn("covariance", F.round("covariance", 6) + F.lit(0.0))


@register("m09_projection_on_two_features", q("""SELECT enterprise_code, incident_time, threat_code,
    round((z1 + CASE WHEN r >= 0 THEN z2 ELSE -z2 END) / sqrt(2), 6) + 0.0 AS pca1,
    round((z1 - CASE WHEN r >= 0 THEN z2 ELSE -z2 END) / sqrt(2), 6) + 0.0 AS pca2
    FROM (SELECT enterprise_code, incident_time, threat_code, (host_count - avg(host_count) OVER ()) / stddev_pop(host_count) OVER () AS z1,
                 (hour - avg(hour) OVER ()) / stddev_pop(hour) OVER () AS z2 FROM cal), (SELECT corr(host_count, hour) AS r FROM cal)"""), "M09")
def m09_two(spark, d):
    """Of two scaled features the axes are their sum and difference, so SQL can state the projection."""
    cols = _Z4[:2]
    df = _scaled(spark, d, cols)
    axes = CL.principal_axes(CL.covariance(df, cols), 2)
    return CL.project(df, cols, axes).select("enterprise_code", "incident_time", "threat_code",
                                             *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("pca1", "pca2")])


# ----------------------------------------------------------------- features and importances

@register("m10_feature_list", q("SELECT CAST(position AS INTEGER) AS position, feature FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature" for i, c in enumerate(CF.BASE_NUMERIC)) + "".join(
    f""" UNION ALL SELECT {len(CF.BASE_NUMERIC)} + {shift} + row_number() OVER (ORDER BY {c}) - 2, '{c}_' || {c}
    FROM (SELECT DISTINCT {c} FROM cal) QUALIFY row_number() OVER (ORDER BY {c}) > 1"""
    for c, shift in (("enterprise_type", "0"), ("region", "(SELECT count(DISTINCT enterprise_type) - 1 FROM cal)"),
                     ("season", "(SELECT count(DISTINCT enterprise_type) + count(DISTINCT region) - 2 FROM cal)"))) + ")"), "M10", "M02")
def m10_list(spark, d):
    _, features, _ = CF.model_frame(E.feature_frame(T.incidents_li(spark, d), T.threats(spark, d)))
    return spark.createDataFrame(list(enumerate(features)), "position int, feature string")


@register("m16_selection_above_quantile", q("""SELECT feature, importance FROM r
    WHERE importance > (SELECT quantile_cont(importance, 0.3) FROM r)""", ctes=(
    "r AS (SELECT region AS feature, avg(host_count) AS importance FROM cal GROUP BY region)",)), "M15", "M16")
def m16_given(spark, d):
    importances = _li(spark, d).groupBy(F.col("region").alias("feature")).agg(F.avg("host_count").alias("importance"))
    return MT.select_above_quantile(importances, K.IMPORTANCE_QUANTILE)


# ----------------------------------------------------------------- metrics

_PREDICTED = "pred AS (SELECT threat_code % 5 AS label, (threat_code * 3 + host_count) % 5 AS prediction FROM incidents_li)"


def _predicted(spark, d):
    return T.incidents_li(spark, d).select((F.col("threat_code") % 5).alias("label"),
                                           ((F.col("threat_code") * 3 + F.col("host_count")) % 5).alias("prediction"), "threat_code", "host_count")


@register("m18_accuracy_of_given_predictions", q("SELECT avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM pred", cal=False,
                                                 ctes=(_PREDICTED,)), "M18")
def m18_given(spark, d):
    return MT.accuracy(_predicted(spark, d))


@register("m19_report_of_given_predictions", q("""SELECT * FROM (
    SELECT CAST(c AS VARCHAR) AS cls, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM per
    UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM per
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
      round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM per)""", cal=False, ctes=(_PREDICTED,
    """counts AS (SELECT c, (SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS tp,
      (SELECT count(*) FROM pred WHERE label = c) AS support, (SELECT count(*) FROM pred WHERE prediction = c) AS predicted FROM range(5) t(c))""",
    """per AS (SELECT c, support, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
      coalesce(2.0::DOUBLE * tp / nullif(predicted + support, 0), 0) AS f1 FROM counts)""")), "M19")
def m19_given(spark, d):
    out = MT.classification_report(_predicted(spark, d))
    return out.select("cls", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_PROB = "((threat_code * (c + 2) + host_count * 3) % 11)"


@register("m25_top3_of_given_probabilities", q(f"""SELECT avg(CAST(better < 3 AS INTEGER)) AS top3_accuracy FROM (
    SELECT len(list_filter(list_transform(range(5), lambda c: {_PROB}), lambda p: p > {_PROB.replace('c + 2', 'threat_code % 5 + 2')})) AS better
    FROM incidents_li)""", cal=False), "M25")
def m25_given(spark, d):
    rows = _predicted(spark, d)
    probs = F.array(*[((F.col("threat_code") * (c + 2) + F.col("host_count") * 3) % 11).cast("double") for c in range(5)])
    return MT.top_k_accuracy(rows.withColumn("probs", probs), 3)


@register("m23_champion_of_given_predictions", q("""SELECT CASE WHEN avg(CAST(label = prediction AS INTEGER)) <
    avg(CAST(label = host_count % 5 AS INTEGER)) THEN 'baseline' ELSE 'improved' END AS champion
    FROM (SELECT threat_code % 5 AS label, (threat_code * 3 + host_count) % 5 AS prediction, host_count FROM incidents_li)""", cal=False),
    "M23", "R03")
def m23_given(spark, d):
    rows = _predicted(spark, d)
    improved = MT.accuracy(rows).first()[0]
    baseline = MT.accuracy(rows.withColumn("prediction", F.col("host_count") % 5)).first()[0]
    return spark.createDataFrame([(MT.champion(improved, baseline),)], "champion string")


# ----------------------------------------------------------------- fixed trees

def stump(feature: int, threshold: float, left: float, right: float, cover: tuple[float, float] = (1.0, 1.0)) -> dict:
    """A tree of one split: ``left`` up to the threshold, ``right`` above it."""
    return {"feature": np.array([feature, 0, 0]), "threshold": np.array([threshold, 0.0, 0.0]), "bin": np.zeros(3, np.int64),
            "left": np.array([1, -1, -1]), "right": np.array([2, -1, -1]), "value": np.array([0.0, left, right]),
            "cover": np.array([sum(cover), *cover]), "gain": np.array([1.0, 0.0, 0.0])}


#: (feature, threshold, value up to it, value above it, cover of both sides)
SUCCESS_STUMPS = (("host_count", 20.5, -0.4, 0.3, (3.0, 1.0)), ("region_freq", 100.5, 0.2, -0.7, (1.0, 4.0)),
                  ("host_count", 35.5, 0.1, 0.6, (5.0, 2.0)), ("night_attack", 0.5, -0.1, 0.25, (2.0, 2.0)))
SUCCESS_INPUTS = ["host_count", "region_freq", "night_attack", "not_in_the_data"]
THREAT_STUMPS = ((("is_weekend", 0.5, 0.2, -0.3), ("hour_sin", 0.25, 0.1, 0.4), ("host_count", 12.5, -0.2, 0.35)),
                 (("host_count", 30.5, 0.5, -0.5), ("night_attack", 0.5, 0.15, -0.05), ("hour_sin", -0.25, 0.3, 0.05)))
THREAT_INPUTS = ["is_weekend", "hour_sin", "host_count", "night_attack"]


def success_model() -> BoostedTrees:
    return BoostedTrees([[stump(SUCCESS_INPUTS.index(f), t, a, b, c)] for f, t, a, b, c in SUCCESS_STUMPS], 1, len(SUCCESS_INPUTS))


def threat_model() -> BoostedTrees:
    return BoostedTrees([[stump(THREAT_INPUTS.index(f), t, a, b) for f, t, a, b in trees] for trees in THREAT_STUMPS], 3, len(THREAT_INPUTS))


def _margin_sql(stumps) -> str:
    return " + ".join(f"CASE WHEN {f} <= {t} THEN {a}::DOUBLE ELSE {b}::DOUBLE END" for f, t, a, b, *_ in stumps)


_SUCCESS_SQL = f"1 / (1 + exp(-({_margin_sql(SUCCESS_STUMPS)})))"
_THREAT_SQL = [_margin_sql([trees[c] for trees in THREAT_STUMPS]) for c in range(3)]


@register("m24_probabilities_of_given_trees", q(f"""SELECT enterprise_code, incident_time, threat_code, CAST(CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0
    WHEN m1 >= m2 THEN 1 ELSE 2 END AS INTEGER) AS class, round(exp(m0) / (exp(m0) + exp(m1) + exp(m2)), 9) AS p0,
    round(exp(m1) / (exp(m0) + exp(m1) + exp(m2)), 9) AS p1, round(exp(m2) / (exp(m0) + exp(m1) + exp(m2)), 9) AS p2
    FROM (SELECT *, {', '.join(f'{m} AS m{c}' for c, m in enumerate(_THREAT_SQL))} FROM feat)""", feat=True), "M24", "M21", "M22")
def m24_given(spark, d):
    df = cal.with_cyclic(cal.with_time_flags(_li(spark, d)))
    out = threat_model().transform(CF.assemble(df, THREAT_INPUTS))
    p = vector_to_array("probability")
    return out.select("enterprise_code", "incident_time", "threat_code", F.col("prediction").cast("int").alias("class"),
                      *[F.round(p[c], 9).alias(f"p{c}") for c in range(3)])


def _contribution_sql(feature: str) -> str:
    """Shapley values of one-split trees: the leaf's value less the mean of both, weighted by cover."""
    parts = [f"(CASE WHEN {f} <= {t} THEN {a}::DOUBLE ELSE {b}::DOUBLE END - {(a * c[0] + b * c[1]) / (c[0] + c[1])!r}::DOUBLE)"
             for f, t, a, b, c in SUCCESS_STUMPS if f == feature]
    return " + ".join(parts)


@register("m26_attributions_of_given_trees", q(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(abs({_contribution_sql(f)})), 9) AS mean_abs_contribution FROM feat"
    for f in SUCCESS_INPUTS[:3]) + " UNION ALL SELECT 'not_in_the_data', 0.0::DOUBLE", feat=True), "M26", "P23")
def m26_given(spark, d):
    df = E.feature_frame(T.incidents_li(spark, d), T.threats(spark, d))
    rows = SC.aligned_vector(df, SUCCESS_INPUTS, "features")
    return XP.summary(rows, success_model(), SUCCESS_INPUTS).select("feature", F.round("mean_abs_contribution", 9).alias("mean_abs_contribution"))


@register("p22_p23_clean_and_align", q("""SELECT incident_id, CASE WHEN host_count % 5 IN (0, 1, 2) OR host_count IS NULL THEN 0.0::DOUBLE
    ELSE CAST(host_count AS DOUBLE) END AS cleaned, 0.0::DOUBLE AS missing FROM incidents_ev""", src="incidents_ev", cal=False), "P22", "P23")
def p22_given(spark, d):
    """Null, NaN and infinite values become 0, and so does a column that the data lack."""
    n = F.col("host_count") % 5
    raw = (F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("inf"))).when(n == 2, F.lit(None).cast("double"))
           .otherwise(F.col("host_count").cast("double")))
    rows = T.incidents_ev(spark, d).select("incident_id", raw.alias("raw")).withColumn("again", clean_number("raw"))
    out = SC.aligned_vector(rows, ["raw", "absent"], "v").withColumn("v", vector_to_array("v"))
    same = F.when(F.col("v")[0] == F.col("again"), F.col("v")[0])
    return out.select("incident_id", same.alias("cleaned"), F.col("v")[1].alias("missing"))


# ----------------------------------------------------------------- scoring with fixed models

def artifacts(spark, d) -> SC.Artifacts:
    """Artifacts with the tables' own vocabularies, frequencies and levels, and with the fixed centres and trees."""
    train = T.incidents_li(spark, d)
    voc = reliable_checkpoint(EN.vocabularies(E.categorical_frame(train), CL.CAT_COLS))
    vocabs = {c: voc.where(F.col("column_name") == c).select("value", "code") for c in CL.CAT_COLS}
    freqs = {n: E.frequency(train, k, n) for n, k in SC.FREQS.items()}
    levels = {c: EN.category_levels(cal.with_calendar(train), c) for c in CF.OHE_COLS}
    # Columns other than the first two have no spread, so they are 0 after scaling.
    width = len(CL.CLUSTER_FEATURES)
    scaler = EN.PopulationScaler(CL.CLUSTER_FEATURES, [0.0] * width, [1.0, 1.0, *[0.0] * (width - 2)])
    classes = spark.createDataFrame([(11, 0), (22, 1), (33, 2)], "threat_code int, class_code int")
    return SC.Artifacts(vocabs, freqs, levels, scaler, _centre_model(spark, width), success_model(), SUCCESS_INPUTS,
                        threat_model(), THREAT_INPUTS, classes)


_SCORED = f"""scored AS (SELECT incident_id, region, enterprise_type, hour, dow, {_NEAREST} AS centre, {_SUCCESS_SQL} AS success_probability,
    [{', '.join(_THREAT_SQL)}] AS m FROM (SELECT c.*, coalesce(f.n, 0) AS region_freq, CAST(hour >= 22 OR hour <= 5 AS INTEGER) AS night_attack,
      CAST(dow IN (5, 6) AS INTEGER) AS is_weekend, sin(2 * pi() * hour / 24.0) AS hour_sin
      FROM cal c LEFT JOIN (SELECT region, count(*) AS n FROM incidents_li GROUP BY region) f USING (region)))"""
_SCORES = """SELECT incident_id, centre, round(success_probability, 9) AS success_probability,
    CAST(list_position(m, list_max(m)) * 11 AS INTEGER) AS predicted_threat,
    round(exp(list_max(m)) / (exp(m[1]) + exp(m[2]) + exp(m[3])), 9) AS threat_probability FROM scored"""


def _score_columns(scored, art):
    return scored.select("incident_id", _centre_x(art.kmeans).alias("centre"), F.round("success_probability", 9).alias("success_probability"),
                         "predicted_threat", F.round("threat_probability", 9).alias("threat_probability"))


@register("m27_m28_scores_of_given_models", q(_SCORES, src="incidents_ev", views=("incidents_li",), ctes=(_SCORED,)),
          "M27", "M28", "P22", "P23", "J04", "M08", "P05")
def m27_given(spark, d):
    art = artifacts(spark, d)
    return _score_columns(SC.score(T.incidents_ev(spark, d), art), art)


@register("s20_scores_of_saved_models", q(_SCORES, src="incidents_ev", views=("incidents_li",), ctes=(_SCORED,)), "S20", "M27", "M28")
def s20_given(spark, d):
    path = scratch_path(spark, f"artifacts-{uuid.uuid4().hex[:12]}")
    artifacts(spark, d).save(path)
    art = SC.Artifacts.load(spark, path)
    return _score_columns(SC.score(T.incidents_ev(spark, d), art), art)


@register("t05_stream_scores_of_given_models", q(_SCORES, src="incidents_ev", views=("incidents_li",), ctes=(_SCORED,)), "T05", "S16", "M27")
def t05_given(spark, d):
    art = artifacts(spark, d)
    src, sink, ck = J.fresh(spark, "events-src"), J.fresh(spark, "scores-sink"), J.fresh(spark, "scores-ckpt")
    J.replay(T.table(spark, d, "events"), src, lambda: J.run_to_sink(
        J.incident_stream(spark, src, d), sink, ck, transform=lambda batch: _score_columns(SC.score(batch, art), art)), chunks=2)
    return J.read_sink(spark, sink).drop("batch_id")


# ----------------------------------------------------------------- texts

@register("r04_forecast_texts", q(f"""SELECT incident_id, '{K.FORECAST_RULE}' || chr(10) || '{K.FORECAST_HEADING}' || chr(10) || '{K.FORECAST_REGION}'
    || 'Nation_' || substr(region, 8) || chr(10) || '{K.FORECAST_INDUSTRY}' || upper(substr(enterprise_type, 1, 1)) || lower(substr(enterprise_type, 2))
    || chr(10) || printf('   Время атаки:     %02d:00 (День %d)', hour, dow) || chr(10)
    || printf('   Вероятность успеха: %.2f%%', (host_count % 101) / 100.0 * 100) || chr(10) || '{K.FORECAST_RULE}' AS card,
    'North-' || upper(substr(region, 1, 1)) || lower(substr(region, 2)) || ' Of X''Y' AS titled FROM cal""", src="incidents_ev"), "R04", "P24")
def r04_texts(spark, d):
    """The forecast text of every incident, for a probability that is a formula of its hosts."""
    df = cal.with_calendar(T.incidents_ev(spark, d))
    return df.select("incident_id", forecast_card("region", "enterprise_type", "hour", "dow", (F.col("host_count") % 101) / 100.0).alias("card"),
                     title(F.concat(F.lit("NORTH-"), "region", F.lit(" OF x'y"))).alias("titled"))


@register("r02_model_lines_of_given_models", q(f"""SELECT 5 AS line_no, '{K.REC_CLUSTER.replace("{items}", "")}' ||
    (SELECT '[' || string_agg(CAST(cluster AS VARCHAR), ', ' ORDER BY rate DESC, cluster) || ']' FROM (
      SELECT cluster, avg(success) AS rate FROM clustered GROUP BY cluster ORDER BY rate DESC, cluster LIMIT 2)) AS line
    UNION ALL SELECT 6, '{K.REC_FACTORS.replace("{items}", "")}' ||
    (SELECT '{{' || string_agg('''' || region || ''': ' || CAST(n AS VARCHAR) || '.0', ', ' ORDER BY n DESC, region) || '}}' FROM (
      SELECT region, max(host_count) + count(*) % 7 AS n FROM clustered GROUP BY region ORDER BY n DESC, region LIMIT 3))""", ctes=(_CLUSTERED,)),
    "R02", "A15", "M15")
def r02_given(spark, d):
    rows = _by_formula(_li(spark, d))
    importances = rows.groupBy(F.col("region").alias("feature")).agg(
        (F.max("host_count") + F.count(F.lit(1)) % 7).cast("double").alias("importance"))
    return R.model_lines(CL.risk(rows), importances)
