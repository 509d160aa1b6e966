"""Invariants of the fitted ML operators: run once on sf0.001 with the check profile."""

import math
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.ml import classify as CF
from riskloom.ml import encode as EN
from riskloom.ml import explain as XP
from riskloom.ml import score as SC
from riskloom.ml.split import balanced_weight, stratified_split
from riskloom.plans import analysis as AN
from riskloom.plans import catalog, queries_ml
from riskloom.session import scratch_path
from riskloom.sources import tables as T


@pytest.fixture(scope="module")
def analysis(spark):
    return AN.analysis_for(spark, SF_SMALL, AN.CHECK)


def test_label_codes_dense_from_zero(analysis):
    for col, vocab in analysis.vocabs.items():
        codes = sorted(r.code for r in vocab.collect())
        assert codes == list(range(len(codes))), col


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 5000).select(F.format_string("v%05d", (F.col("id") * 7919) % 5000).alias("x"))
    out = EN.dense_index(df, "x", partitions=16).orderBy("code").collect()
    assert [r.code for r in out] == list(range(5000))
    assert [r.x for r in out] == sorted(r.x for r in out)


def test_split_sizes_per_class(spark):
    inc = T.incidents_li(spark, SF_SMALL).select(*AN.LI_ID_COLS)
    split = stratified_split(inc, "success", AN.LI_ID_COLS)
    rows = split.groupBy("success").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    for r in rows:
        assert r.t == math.ceil(0.2 * r.n)
    assert split.count() == inc.count()


def test_split_matches_brute_force(spark):
    """Exact hash split = rank by md5 within class, on data that spans many hash buckets."""
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("rid"),
                                     (F.col("id") % 3).cast("int").alias("label"))
    got = {r.rid for r in stratified_split(df, "label", ["rid"]).where("is_test").collect()}
    pdf = df.withColumn("h", F.md5(F.concat_ws("|", F.lit("42"), "rid"))).toPandas()
    want = set()
    for _, g in pdf.groupby("label"):
        k = math.ceil(0.2 * len(g))
        want |= set(g.sort_values(["h", "rid"]).head(k)["rid"])
    assert got == want


def test_balanced_weights_sum_to_n(spark):
    df = spark.createDataFrame([(c,) for c in [0] * 7 + [1] * 2 + [2]], "c int")
    w = balanced_weight(df, "c")
    assert abs(w.agg(F.sum("weight")).first()[0] - 10.0) < 1e-9


def test_kept_restart_has_least_cost(spark, analysis):
    from riskloom.ml import cluster as CL
    vec = CL.scaled_vectors(analysis.frame, analysis.scaler)
    costs = []
    for s in (42, 7):
        costs.append(CL.fit_kmeans(vec, 3, seeds=(s,), max_iter=10).summary.trainingCost)
    best = CL.fit_kmeans(vec, 3, seeds=(42, 7), max_iter=10).summary.trainingCost
    assert abs(best - min(costs)) < 1e-6 * max(1.0, min(costs))


def test_sweep_choice(analysis):
    best = max(analysis.sweep.table, key=lambda r: (r[2], -r[0]))
    assert analysis.best_k == best[0]
    assert [r[0] for r in analysis.sweep.table] == list(range(2, 11))


def test_probabilities_sum_to_one(analysis):
    probs = analysis.threat.test_scored.select("probs").toPandas()["probs"]
    assert all(abs(sum(p) - 1.0) < 1e-9 for p in probs)
    assert 0.0 <= analysis.threat.top3 <= 1.0


def test_attributions_sum_to_margin(spark, analysis):
    s = analysis.success
    test = s.test_predictions.withColumn("raw", vector_to_array("rawPrediction")[1])
    c = XP.contributions(test, s.final, keep=("raw",)).toPandas()
    raw = c["raw"].to_numpy()
    assert np.allclose(c["margin"].to_numpy(), raw, atol=1e-9)           # the walk reproduces the model
    sums = np.array([np.sum(v) for v in c["contrib"]]) + c["bias"].to_numpy()
    assert np.allclose(sums, c["margin"].to_numpy(), atol=1e-9)          # contributions add up


def test_save_load_scores_equal(spark, analysis):
    art = SC.artifacts_from(analysis)
    path = scratch_path(spark, f"art-{uuid.uuid4().hex[:8]}")
    art.save(path)
    loaded = SC.Artifacts.load(spark, path)
    inc = T.incidents_ev(spark, SF_SMALL)
    cols = ["incident_id", "cluster", "success_probability", "predicted_threat", "threat_probability"]
    a = SC.score(inc, art).select(*cols).orderBy("incident_id").toPandas()
    b = SC.score(inc, loaded).select(*cols).orderBy("incident_id").toPandas()
    assert a.equals(b)
    assert a["success_probability"].between(0, 1).all()


def test_reference_batch_frequencies(spark, analysis):
    art = SC.artifacts_from(analysis)
    inc = T.incidents_ev(spark, SF_SMALL)
    d = SC.derive(inc, art, batch_freq=True)
    row = d.agg(F.max("threat_freq").alias("tf"), F.min("industry_threat").alias("it")).first()
    assert row.tf == 0 and row.it.endswith("_0")                         # D14 reproduced on request


def test_model_frame_feature_list(analysis):
    cols = analysis.feature_cols
    assert cols[:8] == CF.BASE_NUMERIC[:8]
    assert not any(c in cols for c in ("hour", "dow", "month", "cluster"))   # D12
    assert "enterprise_type_AUTOMOBILE" not in cols                         # first level dropped


def test_importances_normalised(spark, analysis):
    imp = CF.importances(spark, analysis.success.baseline, analysis.success.features)
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1.0) < 1e-9


def test_vector_probabilities_column(analysis):
    p = analysis.success.test_predictions.select(vector_to_array("probability").alias("p")).first().p
    assert abs(sum(p) - 1.0) < 1e-9


def test_tree_shap_equals_brute_force_shapley(spark):
    """Exact path-dependent Shapley values: table lookup = enumeration over all feature subsets."""
    from itertools import combinations
    from math import factorial

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    rows = [(float((i * 7) % 3 == 0), Vectors.dense([i % 5, (i * 3) % 7, i % 3, (i * 11) % 4]), 1.0 + i % 3)
            for i in range(400)]
    df = spark.createDataFrame(rows, ["label", "features", "w"])
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=3, weightCol="w").fit(df)
    trees = XP.tree_arrays(model)

    def cond_exp(a, node, x, S):
        if a["left"][node] < 0:
            return a["value"][node]
        f, t = int(a["feature"][node]), a["threshold"][node]
        lft, rgt = a["left"][node], a["right"][node]
        if f in S:
            return cond_exp(a, lft if x[f] <= t else rgt, x, S)
        c = a["cover"][node]
        return (a["cover"][lft] * cond_exp(a, lft, x, S) + a["cover"][rgt] * cond_exp(a, rgt, x, S)) / c

    def v(x, S):
        return sum(w * cond_exp(a, 0, x, S) for w, a in trees)

    X = np.array([r[1].toArray() for r in rows[:25]])
    d = X.shape[1]
    got = XP.contributions(spark.createDataFrame([(r[1],) for r in rows[:25]], ["features"]), model).toPandas()
    for n, x in enumerate(X):
        want = np.zeros(d)
        for i in range(d):
            rest = [k for k in range(d) if k != i]
            for s in range(d):
                for S in combinations(rest, s):
                    wgt = factorial(s) * factorial(d - s - 1) / factorial(d)
                    want[i] += wgt * (v(x, set(S) | {i}) - v(x, set(S)))
        assert np.allclose(got["contrib"][n], want, atol=1e-9)
        assert abs(got["bias"][n] - v(x, set())) < 1e-9                       # E[f]
        assert abs(np.sum(got["contrib"][n]) + got["bias"][n] - got["margin"][n]) < 1e-9


@pytest.mark.parametrize("name, step, table", [("m12_positive_class_weight", "positive_weight", "train-labels"),
                                               ("m13_balanced_weights", "stratified_split", "threat-rows")])
def test_weights_read_kept_rows(spark, monkeypatch, name, step, table):
    """The joined incidents are not made again for each step."""
    read, plain = [], getattr(queries_ml, step)
    monkeypatch.setattr(queries_ml, step, lambda df, *a, **k: (read.extend(df.inputFiles()), plain(df, *a, **k))[1])
    assert catalog.REGISTRY[name].build(spark, SF_SMALL).count() > 0
    assert read and all(f"/{table}-" in path for path in read)


def test_a_part_of_the_analysis_is_made_alone_and_once(spark, monkeypatch):
    made, rows = [], spark.range(3)
    monkeypatch.setattr(AN, "feature_frame", lambda *a: rows)
    monkeypatch.setattr(AN, "checkpoint_spread", lambda df: df)
    monkeypatch.setattr(AN.CL, "encode_for_clustering", lambda df: (df, {}))
    monkeypatch.setattr(AN.CF, "model_frame", lambda df: (df, ["a"], {}))
    monkeypatch.setattr(AN.CF, "train_success", lambda df, cols, ids, p: made.append(("success", cols)) or "s")
    monkeypatch.setattr(AN.CF, "train_threat", lambda df, cols, ids, k, b, i: made.append(("threat", cols)) or "t")
    a = AN.Analysis(None, None, AN.CHECK)
    assert a.feature_cols == ["a"] and made == []
    assert a.with_parts("success").success == "s" and made == [("success", ["a"])]
    assert a.with_parts("success", "threat").threat == "t" and sorted(made) == [("success", ["a"]), ("threat", ["a"])]


def test_sweep_side_by_side_equals_one_at_a_time(spark, monkeypatch):
    from riskloom.ml import cluster as CL
    vec = spark.range(400).select(F.rand(3).alias("x"), F.rand(5).alias("y"))
    vec = CF.assemble(vec, ["x", "y"]).repartition(2, "x").cache()
    got = []
    for n in (3, 1):
        monkeypatch.setattr(CL, "SWEEP_FITS", n)
        got.append(CL.sweep(vec, (2, 3, 4), (42,), 5))
    assert [r[0] for r in got[0].table] == [2, 3, 4]
    assert np.allclose(got[0].table, got[1].table) and set(got[0].models) == {2, 3, 4}


def _points(spark, n=3000, parts=5):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (n // 3, 2)) for c in ((0, 0), (4, 1), (1, 6))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.permutation(x)], "x double, y double")
    return CF.assemble(df.repartition(parts), ["x", "y"])


def test_registered_queries_fit_the_whole_profile(spark, monkeypatch):
    """No restart, iteration or round of the reference is left out."""
    from riskloom.plans import queries_stream
    asked = []
    monkeypatch.setattr(AN, "analysis_for", lambda spark, d, profile=AN.REFERENCE: asked.append(profile) or 1 / 0)
    for build in (lambda: queries_ml._an(spark, SF_SMALL), lambda: queries_stream.t05(spark, SF_SMALL)):
        with pytest.raises(ZeroDivisionError):
            build()
    full = AN.REFERENCE
    assert asked == [full, full] and len(full.seeds) == 10 and full.kmeans_iter == 300 and full.ks == tuple(range(2, 11))
    assert (full.success.rounds, full.threat_baseline.rounds, full.threat_improved.rounds) == (300, 200, 300)


def test_restarts_side_by_side_are_lloyds_iterations(spark):
    """Each restart ends where a plain loop from its first centres ends, and the least cost is kept."""
    from riskloom.ml import cluster as CL
    df = _points(spark)
    x = np.array([r.features.toArray() for r in df.select("features").collect()])
    blocks, _ = CL.packed(df)
    km = CL.KMeans(4, (1, 2, 3), 40)
    costs = []
    for c in km.first_centres(blocks):
        assert c.shape == (4, 2)
        for _ in range(km.max_iter):
            far = ((x[:, None] - c[None]) ** 2).sum(2)
            label, cost = far.argmin(1), far.min(1).sum()
            moved = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(4)])
            still, c = ((moved - c) ** 2).sum(1).max() > km.tol ** 2, moved
            if not still:
                break
        costs.append((cost, c))
    model = km.fit(blocks)
    cost, centres = min(costs, key=lambda v: v[0])
    assert math.isclose(model.summary.trainingCost, cost, rel_tol=1e-9)
    assert np.allclose(np.array(model.clusterCenters()), centres, atol=1e-9)


def test_silhouettes_equal_sparks(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator

    from riskloom.ml import cluster as CL
    df = _points(spark).cache()
    swept = CL.sweep(df, (2, 3, 5), (1, 2), 20)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction", distanceMeasure="squaredEuclidean")
    for k, cost, s in swept.table:
        scored = swept.models[k].transform(df)
        assert math.isclose(s, ev.evaluate(scored), rel_tol=1e-9)
        assert cost == swept.models[k].summary.trainingCost
    assert swept.best_k == 3


def test_the_projection_needs_no_clusters(spark, monkeypatch):
    a = AN.Analysis(T.incidents_li(spark, SF_SMALL), T.threats(spark, SF_SMALL), AN.CHECK)
    monkeypatch.setattr(AN.CL, "sweep", lambda *x: 1 / 0)
    rows, axes = a.projection
    assert axes.shape == (len(AN.CL.CLUSTER_FEATURES), 2) and {"pca1", "pca2"} <= set(rows.columns)
    with pytest.raises(ZeroDivisionError):
        a.clusters
