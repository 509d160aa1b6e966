"""Several group-bys over one scan.

The groupings of a report go over the same rows.  One ``GROUPING SETS`` aggregate reads and shuffles them
once: each task combines its rows by every key before anything is sent, so what is shuffled is the sum of the
groups, not the rows times the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_each(df: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """(dimension, *keys, n[, n_label, total]): the groups of every key; a row has a value in the key of its dimension only."""
    sums = [F.count(F.lit(1)).alias("n")]
    if label:
        sums += [F.count(label).alias("n_label"), F.sum(label).alias("total")]
    dimension = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]).alias("dimension")
    return df.groupingSets([[k] for k in keys], *keys).agg(dimension, *sums).select(
        "dimension", *keys, "n", *(["n_label", "total"] if label else []))


def value_text(keys: list[str]) -> Column:
    """The value of a row of ``by_each`` as text."""
    return F.coalesce(*[F.col(k).cast("string") for k in keys])


def best_of_each(groups: DataFrame, keys: list[str], most: dict[str, int]) -> DataFrame:
    """(dimension, rank, value, success_rate) of the ``most[dimension]`` greatest rates of each dimension, ties to the smaller key.

    The rank limit reaches the tasks before the shuffle, so a dimension of many groups is not gathered.
    """
    rated = groups.withColumn("success_rate", F.try_divide(F.col("total").cast("double"), F.col("n_label")))
    ranked = rated.withColumn("rank", F.row_number().over(
        Window.partitionBy("dimension").orderBy(F.desc("success_rate"), *keys))).where(F.col("rank") <= max(most.values()))
    limit = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(n)) for d, n in most.items()])
    return ranked.where(F.col("rank") <= limit).select("dimension", "rank", value_text(keys).alias("value"), "success_rate")


def date_levels(df: DataFrame, year: int, month: int, date_col: str = "incident_date") -> DataFrame:
    """(level, value, n): the counts of all years, of the months of ``year`` and of the days of its ``month``."""
    d = F.col(date_col)
    in_year = F.year(d) == year
    keyed = df.where(d.isNotNull()).select(
        F.year(d).alias("year"), F.when(in_year, F.month(d)).alias("month"),
        F.when(in_year & (F.month(d) == month), F.dayofmonth(d)).alias("day"))
    out = by_each(keyed, ["year", "month", "day"])
    return out.select(F.col("dimension").alias("level"), F.coalesce("year", "month", "day").alias("value"), "n").where(
        F.col("value").isNotNull())


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct non-null values of each column, as text."""
    out = by_each(df.select(*columns), columns)
    return out.select(F.col("dimension").alias("facet"), value_text(columns).alias("value")).where(F.col("value").isNotNull())
