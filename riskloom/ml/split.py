"""Stratified hash split and class weights.

The split is exact and reproducible: in every class the ``ceil(f · n_c)`` rows
with the smallest ``md5(seed | id)`` (ties by the id columns) form the test
set.  It is computed without ranking a whole class in one task:

1. the first four hex digits of the hash give 2^16 buckets; bucket counts per
   class are a small aggregate (partial combine, at most classes × 2^16 rows);
2. a running sum per class finds the boundary bucket that holds the
   ``k_c``-th row; rows below it are test, rows above it train;
3. only rows of the boundary bucket (about n_c / 2^16 of the class) are ranked.

The per-class boundary table has one row per class and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.joins import bounded_broadcast

BUCKET_HEX_DIGITS = 4


def split_hash(seed: int, id_cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def stratified_split(df: DataFrame, label: str, id_cols, test_fraction: float = K.TEST_FRACTION,
                     seed: int = K.SPLIT_SEED, out: str = "is_test") -> DataFrame:      # M11
    h = df.withColumn("_h", split_hash(seed, id_cols)) \
          .withColumn("_b", F.conv(F.substring("_h", 1, BUCKET_HEX_DIGITS), 16, 10).cast("int"))
    buckets = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(label).orderBy("_b")
    cum = (buckets
           .withColumn("_through", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(label)))
           .withColumn("_k", _exact_ceil(F.col("_n"), test_fraction)))
    bounds = (cum.where((F.col("_through") - F.col("_cnt") < F.col("_k")) & (F.col("_through") >= F.col("_k")))
              .select(label, F.col("_b").alias("_edge"),
                      (F.col("_k") - (F.col("_through") - F.col("_cnt"))).alias("_need")))
    tagged = h.join(bounded_broadcast(bounds), label, "left")           # one row per class
    sure = tagged.where(F.col("_edge").isNull() | (F.col("_b") != F.col("_edge"))) \
        .withColumn(out, F.coalesce(F.col("_b") < F.col("_edge"), F.lit(False)))
    order = [F.col("_h")] + [F.col(c) for c in id_cols]
    edge = tagged.where(F.col("_b") == F.col("_edge")) \
        .withColumn(out, F.row_number().over(Window.partitionBy(label).orderBy(*order)) <= F.col("_need"))
    return sure.unionByName(edge).drop("_h", "_b", "_edge", "_need")


def _exact_ceil(n: Column, fraction: float) -> Column:
    """ceil(fraction · n) computed on decimals, so 0.2 · 10 gives 2 and not 3."""
    scale = 10 ** 6
    num = int(round(fraction * scale))
    return F.floor((n * F.lit(num) + F.lit(scale - 1)) / F.lit(scale)).cast("bigint")


def positive_weight(train: DataFrame, label: str = "success", out: str = "weight") -> tuple[DataFrame, float]:   # M12
    """Weight column: ``n_neg / n_pos`` for positives, 1 for negatives (scale_pos_weight)."""
    row = train.agg(F.sum((F.col(label) == 0).cast("int")).alias("neg"),
                    F.sum((F.col(label) == 1).cast("int")).alias("pos")).first()
    ratio = float(row["neg"]) / float(row["pos"]) if row["pos"] else 1.0
    return train.withColumn(out, F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0))), ratio


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:         # M13
    """``n / (k · n_c)`` per row, from a per-class count table (k rows, broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    tot = totals.first()
    n, k = int(tot["_n"] or 0), int(tot["_k"] or 0)
    w = counts.select(label, (F.lit(float(n)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
    return df.join(bounded_broadcast(w), label, "left")
