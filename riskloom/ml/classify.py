"""Classifiers: attack success (binary) and threat type (softmax), both boosted trees (``ml.boosting``).

M10 (explicit feature list), M14/M17 (baseline and on selected features),
M15 (importances), M20–M22 (top-10 threats, baseline and balanced with
stronger leaf penalties), M23 (champion), M24 (probabilities).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.calendar import CYCLIC_COLUMNS
from riskloom.ml import boosting as BT
from riskloom.ml import encode as EN
from riskloom.ml import metrics as MT
from riskloom.ml.split import balanced_weight, positive_weight, stratified_split
from riskloom.operators.filters import in_top_k
from riskloom.operators.topk import top_k_by_count
from riskloom.session import at_once, checkpoint_spread

OHE_COLS = ["enterprise_type", "region", "season"]
BASE_NUMERIC = ["enterprise_code_num", "host_count", "is_weekend", "night_attack", "working_hours",
                "region_freq", "industry_freq", "threat_freq", *CYCLIC_COLUMNS]
LEAKY = ("threat_freq",)

# The boosting parameters (M14, M17; M21; M22).
SUCCESS = BT.Boosting(rounds=300, step=0.05, depth=5, rows=0.8, features=0.8, l1=0.1, l2=1.0)
THREAT_BASELINE = BT.Boosting(rounds=200, step=0.1, depth=6, rows=0.9, features=0.9)
THREAT_IMPROVED = BT.Boosting(rounds=300, step=0.05, depth=5, rows=0.7, features=0.7, l1=1.0, l2=2.0, least_child=3.0)


def model_frame(features: DataFrame, levels: dict[str, list[str]] | None = None):
    """Features frame → frame with one-hot columns (M02) and the numeric code; returns feature list."""
    df = features.withColumn("enterprise_code_num", F.col("enterprise_code").cast("bigint"))   # S07 strict
    levels = levels or {c: EN.category_levels(df, c) for c in OHE_COLS}
    for c in OHE_COLS:
        df = EN.one_hot(df, c, levels[c])
    dummies = [EN.dummy_name(c, lv) for c in OHE_COLS for lv in levels[c][1:]]
    return df, BASE_NUMERIC + dummies, levels


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def importances(spark: SparkSession, model, cols) -> DataFrame:          # M15
    vals = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(list(cols), [float(v) for v in vals])), "feature string, importance double")


@dataclass
class SuccessResult:
    baseline: BT.BoostedTrees
    final: BT.BoostedTrees
    features: list[str]
    selected: list[str]
    acc_baseline: float
    acc_final: float
    scale_pos_weight: float
    test_predictions: DataFrame
    importances: DataFrame
    extra: dict = field(default_factory=dict)


def train_success(df: DataFrame, features: list[str], id_cols, params: BT.Boosting = SUCCESS) -> SuccessResult:  # M11–M18
    spark = df.sparkSession
    data = stratified_split(df.withColumn("label", F.col("success").cast("double")), "success", id_cols)
    data = checkpoint_spread(data)              # cut lineage: every fit below re-reads this
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    train, ratio = positive_weight(train, "success")

    def fit(columns):
        return BT.fit(assemble(train, columns), "label", id_cols, params, weight="weight", seed=K.SPLIT_SEED)

    base = fit(features)
    acc_b = MT.accuracy(base.transform(assemble(test, features))).first()[0]
    imp = importances(spark, base, features)
    selected = [r["feature"] for r in MT.select_above_quantile(imp, K.IMPORTANCE_QUANTILE).collect()]
    selected = [f for f in features if f in set(selected)]
    final = fit(selected)
    pred_f = final.transform(assemble(test, selected))
    acc_f = MT.accuracy(pred_f).first()[0]
    imp_final = importances(spark, final, selected)
    return SuccessResult(base, final, list(features), selected, float(acc_b), float(acc_f), ratio,
                         pred_f, imp_final)


@dataclass
class ThreatResult:
    model: object
    champion: str
    acc_baseline: float
    acc_improved: float
    top3: float
    classes: DataFrame
    test_scored: DataFrame


def threat_subset(df: DataFrame, k: int = K.TOP_K):                       # M20
    """Rows of the k commonest threat codes with dense class codes by numeric order."""
    top = top_k_by_count(df, "threat_code", k)
    sub = in_top_k(df, top, "threat_code")
    classes = EN.dense_index(top.select("threat_code"), "threat_code", "class_code")
    return sub.join(F.broadcast(classes), "threat_code"), classes       # ≤ k rows


def train_threat(df: DataFrame, features: list[str], id_cols, k: int = K.TOP_K, baseline: BT.Boosting = THREAT_BASELINE,
                 improved: BT.Boosting = THREAT_IMPROVED) -> ThreatResult:  # M20–M25
    sub, classes = threat_subset(df, k)
    data = stratified_split(sub.withColumn("label", F.col("class_code").cast("double")), "class_code", id_cols)
    data = checkpoint_spread(assemble(data, features))
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    n = max(2, classes.count())                                          # at most k
    wtrain = balanced_weight(train, "class_code")                        # M13
    # The two fits need nothing of each other, and a level of few rows is a job of one task.
    model_b, model_e = at_once([
        lambda: BT.fit(train, "label", id_cols, baseline, n, seed=K.SPLIT_SEED),
        lambda: BT.fit(wtrain, "label", id_cols, improved, n, weight="weight", seed=K.SPLIT_SEED)])
    acc_b = float(MT.accuracy(model_b.transform(test)).first()[0])
    acc_e = float(MT.accuracy(model_e.transform(test)).first()[0])
    choice = MT.champion(acc_e, acc_b)                                    # M23
    model = model_b if choice == "baseline" else model_e
    scored = model.transform(test).withColumn("probs", vector_to_array("probability"))   # M24
    top3 = float(MT.top_k_accuracy(scored, 3).first()[0])                # M25
    return ThreatResult(model, choice, acc_b, max(acc_e, acc_b) if choice == "baseline" else acc_e,
                        top3, classes, scored)
