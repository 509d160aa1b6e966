"""Label codes, one-hot columns and the population scaler.

Vocabularies are built distributedly: distinct values are range-partitioned
and sorted, each partition is counted, and a code is the partition's offset
plus the row's rank inside it.  No step gathers the vocabulary into a single
task, and the only driver-side data are the per-partition counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import as_text
from riskloom.operators.joins import bounded_broadcast
from riskloom.session import reliable_checkpoint


def dense_index(values: DataFrame, col: str, index_col: str = "code", partitions: int | None = None,
                group: str | None = None) -> DataFrame:
    """Assign 0-based codes to the distinct ``col`` values in ascending order (per ``group`` if given).

    The range-partitioned values are checkpointed (reliably, to the shared
    checkpoint folder) so the partition ids that the offsets refer to cannot
    change if a task is re-run after an executor loss.
    """
    spark = values.sparkSession
    keys = [group, col] if group else [col]
    gcols = [group] if group else []
    distinct = values.select(*keys).distinct()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = reliable_checkpoint(distinct.repartitionByRange(n, *keys)
                                 .withColumn("_pid", F.spark_partition_id()))
    sizes = parted.groupBy("_pid", *gcols).agg(F.count(F.lit(1)).alias("_n"))     # ≤ n × groups rows
    before = Window.partitionBy(*gcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = parted.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid", *gcols).orderBy(col)))
    return (ranked.join(F.broadcast(offsets.select("_pid", *gcols, "_off")), ["_pid", *gcols])
            .select(*keys, (F.col("_off") + F.col("_rn") - 1).cast("int").alias(index_col)))


def vocabulary(df: DataFrame, col: str) -> DataFrame:                     # M01 fit
    """(value, code) with codes by sorted text of ``str(x)`` (LabelEncoder on astype(str))."""
    return dense_index(df.select(as_text(col).alias("value")), "value")


def vocabularies(df: DataFrame, cols) -> DataFrame:                       # M01 fit, several columns
    """(column_name, value, code) for every column in one pass over ``df``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(c).alias("value")) for c in cols]))
    return dense_index(df.select(pairs.alias("p")).select("p.*"), "value", group="column_name")


def apply_codes(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None) -> DataFrame:   # M01 / J04
    """Code of ``col`` through ``vocab``; unseen values and nulls get 0."""
    out = out or f"{col}_enc"
    lookup = vocab.select(F.col("value").alias("_v"), F.col("code").alias(out))
    keyed = df.withColumn("_v", F.when(F.col(col).isNull(), None).otherwise(as_text(col)))
    return keyed.join(bounded_broadcast(lookup), "_v", "left").drop("_v").withColumn(
        out, F.coalesce(F.col(out), F.lit(0)))


def fit_apply_codes(df: DataFrame, cols) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Label-encode several columns, returning the frame and the fitted vocabularies.

    All vocabularies come from one pass (:func:`vocabularies`).  During
    fitting a null is encoded as the text 'None' (as astype(str) does), so its
    code is the one of 'None' in the sorted vocabulary.
    """
    allv = reliable_checkpoint(vocabularies(df, cols))                    # small: distinct values only
    vocabs = {c: allv.where(F.col("column_name") == c).select("value", "code") for c in cols}
    for c in cols:
        lookup = vocabs[c].select(F.col("value").alias("_v"), F.col("code").alias(f"{c}_enc"))
        df = df.withColumn("_v", as_text(c)).join(bounded_broadcast(lookup), "_v", "left").drop("_v")
    return df, vocabs


def category_levels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct non-null levels (the one-hot schema; collected, like pivot values)."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def dummy_name(col: str, level) -> str:
    return f"{col}_{level}"


def one_hot(df: DataFrame, col: str, levels: list[str], drop_first: bool = True) -> DataFrame:   # M02
    """0/1 columns per level, the first (smallest) level dropped; nulls are all-zero rows."""
    keep = levels[1:] if drop_first else levels
    return df.withColumns({dummy_name(col, lv): (F.col(col) == F.lit(lv)).cast("int") for lv in keep}) \
             .na.fill(0, [dummy_name(col, lv) for lv in keep])


@dataclass
class PopulationScaler:                                                    # M03 / A19 / D17
    cols: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, df: DataFrame, cols) -> "PopulationScaler":
        aggs = []
        for c in cols:
            aggs += [F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double"))]
        row = df.agg(*aggs).first()                      # one row: 2 numbers per column
        means = [float(row[2 * i] or 0.0) for i in range(len(cols))]
        stds = [float(row[2 * i + 1] or 0.0) for i in range(len(cols))]
        return cls(list(cols), means, stds)

    def column(self, c: str, src: Column | None = None) -> Column:
        i = self.cols.index(c)
        x = (src if src is not None else F.col(c)).cast("double")
        if self.stds[i] == 0.0:
            return F.lit(0.0)
        return (x - F.lit(self.means[i])) / F.lit(self.stds[i])

    def transform(self, df: DataFrame, suffix: str = "_z") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.column(c) for c in self.cols})

    def to_dict(self) -> dict:
        return {"cols": self.cols, "means": self.means, "stds": self.stds}

    @classmethod
    def from_dict(cls, d: dict) -> "PopulationScaler":
        return cls(list(d["cols"]), list(d["means"]), list(d["stds"]))
