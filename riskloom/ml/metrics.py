"""Model metrics as aggregates over prediction frames.

All metrics are computed from a confusion table ``groupBy(label, prediction)``
(partial aggregation; at most classes² rows), never by collecting predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:   # M18
    return pred.agg(F.avg((F.col(label).cast("double") == F.col(prediction).cast("double")).cast("int"))
                    .alias("accuracy"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).cast("double").alias("label"),
                        F.col(prediction).cast("double").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:  # M19
    """Per-class precision, recall, F1 and support, plus macro and weighted averages.

    Zero division gives 0, as scikit-learn's default does (with a warning).
    Rows: one per class (``cls`` = the class value as text), then 'macro avg'
    and 'weighted avg'; accuracy is :func:`accuracy`.
    """
    cm = confusion(pred, label, prediction)
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("c"), F.col("n").alias("tp"))
    support = cm.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("predicted"))
    classes = support.select("c").unionByName(predicted.select("c")).distinct()
    per = (classes.join(tp, "c", "left").join(support, "c", "left").join(predicted, "c", "left")
           .na.fill(0, ["tp", "support", "predicted"]))
    per = per.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0)),
    }).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                F.col("precision") + F.col("recall")), F.lit(0.0)))
    per = per.select(F.col("c").cast("bigint").cast("string").alias("cls"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"))
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("cls"),
                       (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"), total.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def top_k_accuracy(scored: DataFrame, k: int = 3, label: str = "label", probs: str = "probs") -> DataFrame:  # M25
    """Share of rows whose true class is among the k most probable.

    ``probs`` is an array of class probabilities indexed by class code.  A row
    counts when fewer than k classes have a strictly greater probability than
    the true one (scikit-learn's tie rule).
    """
    p_true = F.element_at(F.col(probs), F.col(label).cast("int") + 1)
    better = F.size(F.filter(F.col(probs), lambda x: x > p_true))
    return scored.agg(F.avg((better < k).cast("int")).alias(f"top{k}_accuracy"))


def select_above_quantile(importances: DataFrame, q: float = 0.3) -> DataFrame:   # M16 (+A18)
    """Features whose importance is strictly above the exact ``q`` quantile of all importances."""
    # One row per model feature: the threshold is a single scalar.
    thr = importances.agg(F.percentile("importance", F.lit(q)).alias("_t")).first()["_t"]
    return importances.where(F.col("importance") > F.lit(thr))


def champion(acc_improved: float, acc_baseline: float) -> str:                   # M23 / D26
    """'improved' unless it is strictly worse than the baseline."""
    return "baseline" if acc_improved < acc_baseline else "improved"


def rank_importances(importances: DataFrame) -> DataFrame:
    return importances.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("importance"), F.asc("feature"))))
