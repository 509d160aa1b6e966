"""The analysis run: enrich → encode → cluster → classify → rank → report.

This is the reference's analysis script as one Spark plan family.  The
feature frame is written once to the shared checkpoint folder; every
later stage (vocabularies, scaler, k sweep, models, rankings) reads the
table, so lineage stays short and a lost executor recomputes from files.
The clustering, its projection and the two classifiers are parts that run side by side, or alone for a
query that only names one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.ml import boosting as BT
from riskloom.ml import classify as CF
from riskloom.ml import cluster as CL
from riskloom.ml.encode import PopulationScaler
from riskloom.operators.enrich import feature_frame
from riskloom.session import at_once, checkpoint_spread
from riskloom.sources import tables as T


@dataclass(frozen=True)
class Profile:
    """Fit parameters.  ``REFERENCE`` mirrors the reference; ``CHECK`` keeps the same
    structure (same k range, same operators) with fewer iterations for tests; no registered query uses it."""
    name: str = "reference"
    ks: tuple = K.K_RANGE
    seeds: tuple = CL.DEFAULT_SEEDS
    kmeans_iter: int = 300
    success: BT.Boosting = CF.SUCCESS
    threat_baseline: BT.Boosting = CF.THREAT_BASELINE
    threat_improved: BT.Boosting = CF.THREAT_IMPROVED


REFERENCE = Profile()
CHECK = Profile(name="check", seeds=(42,), kmeans_iter=20, success=replace(CF.SUCCESS, rounds=20),
                threat_baseline=replace(CF.THREAT_BASELINE, rounds=20), threat_improved=replace(CF.THREAT_IMPROVED, rounds=20))

# Rows of incidents_li have no id; all columns together identify a row up to exact copies.
LI_ID_COLS = ["enterprise_code", "incident_time", "threat_code", "host_count", "success", "region",
              "enterprise_type", "incident_date"]


@dataclass
class Clusters:
    """The clustering part of a run: rows with encodings, cluster and principal components, and its fits."""

    frame: DataFrame
    sweep: CL.SweepResult
    best_k: int
    kmeans: object
    pca_axes: object


class Analysis:
    """One run.  The parts need only the enriched rows, of which ``clusters`` (with ``projection`` and ``sweep``) also takes
    the codes; each is made when it is first asked for.  ``with_parts`` makes several side by side.
    """

    def __init__(self, incidents: DataFrame, threats: DataFrame, profile: Profile = REFERENCE, id_cols=LI_ID_COLS):
        self.profile, self.id_cols = profile, id_cols
        self._inputs = (incidents, threats)
        self._made: dict = {}
        self._locks = {name: Lock() for name in ("features", "codes", "scaler", "model", "projection", "sweep", "clusters", "success", "threat")}

    def _part(self, name: str, make: Callable):
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = make()
            return self._made[name]

    def with_parts(self, *names: str) -> "Analysis":
        """This run with the parts of these names made."""
        at_once([partial(getattr, self, name) for name in names])
        return self

    @property
    def features(self) -> DataFrame:
        def make():
            # The incidents are a join that the frequencies and the frame would each make again.
            return checkpoint_spread(feature_frame(checkpoint_spread(self._inputs[0]), self._inputs[1]))
        return self._part("features", make)

    @property
    def _codes(self) -> tuple:
        def make():
            enc, vocabs = CL.encode_for_clustering(self.features)
            return checkpoint_spread(enc), vocabs
        return self._part("codes", make)

    @property
    def scaler(self) -> PopulationScaler:
        return self._part("scaler", lambda: PopulationScaler.fit(self.encoded, CL.CLUSTER_FEATURES))

    @property
    def _vectors(self) -> DataFrame:
        return CL.scaled_vectors(self.encoded, self.scaler)

    @property
    def projection(self) -> tuple:
        """(rows with ``pca1`` and ``pca2``, loadings); needs no clusters."""
        return self._part("projection", lambda: CL.pca2(self._vectors))

    @property
    def sweep(self) -> CL.SweepResult:
        return self._part("sweep", lambda: CL.sweep(self._vectors, self.profile.ks, self.profile.seeds, self.profile.kmeans_iter))

    @property
    def clusters(self) -> Clusters:
        def make():
            sw, (with_pca, axes) = self.sweep, self.projection
            km = CL.fit_kmeans(self._vectors, sw.best_k, self.profile.seeds, self.profile.kmeans_iter)
            return Clusters(CL.assign(km, with_pca).drop("features"), sw, sw.best_k, km, axes)
        return self._part("clusters", make)

    @property
    def _model(self) -> tuple:
        return self._part("model", lambda: CF.model_frame(self.features))

    @property
    def success(self) -> CF.SuccessResult:
        return self._part("success", lambda: CF.train_success(*self._model[:2], self.id_cols, self.profile.success))

    @property
    def threat(self) -> CF.ThreatResult:
        return self._part("threat", lambda: CF.train_threat(
            *self._model[:2], self.id_cols, K.TOP_K, self.profile.threat_baseline, self.profile.threat_improved))

    encoded = property(lambda self: self._codes[0])
    vocabs = property(lambda self: self._codes[1])
    frame = property(lambda self: self.clusters.frame)
    best_k = property(lambda self: self.clusters.best_k)
    kmeans = property(lambda self: self.clusters.kmeans)
    pca_axes = property(lambda self: self.projection[1])
    feature_cols = property(lambda self: self._model[1])
    levels = property(lambda self: self._model[2])


def run_analysis(incidents: DataFrame, threats: DataFrame, profile: Profile = REFERENCE,
                 id_cols=LI_ID_COLS) -> Analysis:
    """A whole run, with all its parts."""
    return Analysis(incidents, threats, profile, id_cols).with_parts("clusters", "success", "threat")


_MEMO: dict = {}


def analysis_for(spark: SparkSession, sf_dir: str, profile: Profile = REFERENCE) -> Analysis:
    """One analysis per (session, folder, profile) in this process, shared by the ML queries; each asks for the parts it names."""
    key = (spark.sparkContext.applicationId, sf_dir, profile.name)
    if key not in _MEMO:
        _MEMO[key] = Analysis(T.incidents_li(spark, sf_dir), T.threats(spark, sf_dir), profile)
    return _MEMO[key]


def sweep_table(spark: SparkSession, a: Analysis) -> DataFrame:
    rows = [(k, inertia, sil, k == a.sweep.best_k) for k, inertia, sil in a.sweep.table]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, is_best boolean")


def model_comparison(spark: SparkSession, a: Analysis) -> DataFrame:        # R03 / S21
    s, t = a.success, a.threat
    rows = [
        ("overview", "best_k", float(a.best_k)),
        ("success", "baseline_accuracy", s.acc_baseline),
        ("success", "final_accuracy", s.acc_final),
        ("success", "change", s.acc_final - s.acc_baseline),
        ("success", "selected_features", float(len(s.selected))),
        ("success", "scale_pos_weight", s.scale_pos_weight),
        ("threat", "baseline_accuracy", t.acc_baseline),
        ("threat", "improved_accuracy", t.acc_improved),
        ("threat", "change", t.acc_improved - t.acc_baseline),
        ("threat", "top3_accuracy", t.top3),
        ("threat", "champion_is_baseline", 1.0 if t.champion == "baseline" else 0.0),
    ]
    return spark.createDataFrame(rows, "section string, metric string, value double")


def overview_metrics(incidents: DataFrame) -> DataFrame:                     # S21, deterministic part
    o = incidents.agg(F.count(F.lit(1)).cast("double").alias("incidents"),
                      F.sum("success").cast("double").alias("successes"),
                      (F.avg("success") * 100).alias("success_pct"))
    return o.select(F.explode(F.array(*[
        F.struct(F.lit("overview").alias("section"), F.lit(c).alias("metric"), F.col(c).alias("value"))
        for c in ("incidents", "successes", "success_pct")])).alias("m")).select("m.*")
