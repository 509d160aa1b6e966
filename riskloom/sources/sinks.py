"""Table sinks and audits.

The incident table is written partitioned by month, so the dashboard's
date filters prune whole folders, and read back with an explicit column list
(column pruning reaches the Parquet reader).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wallclock import pad2, year4

INCIDENT_COLUMNS = ["enterprise_type", "enterprise_code", "host_count", "threat_code", "success", "region",
                    "incident_date", "incident_time"]


def write_incident_table(df: DataFrame, path: str) -> None:                      # S18
    """Partitioned write; rows are clustered by month, and months are cut by bytes, so files are neither many nor large.

    ``REBALANCE`` leaves the sizes to adaptive execution (its advisory partition size): a month that
    holds most rows is written by as many tasks as it needs, and small months share a task.
    """
    out = df.withColumn("incident_month", F.concat(year4(F.year("incident_date")), F.lit("-"),
                                                     pad2(F.month("incident_date"))))
    out.hint("rebalance", "incident_month").write.mode("overwrite").partitionBy("incident_month").parquet(path)


def read_incident_table(spark: SparkSession, path: str, columns=INCIDENT_COLUMNS) -> DataFrame:   # S03
    return spark.read.parquet(path).select(*columns)


def write_threat_table(df: DataFrame, path: str) -> None:                        # S18
    df.write.mode("overwrite").parquet(path)


def load_audit(**tables: DataFrame) -> DataFrame:                                # S19
    """(table, rows) per loaded table, one aggregation each, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metrics_table(spark: SparkSession, rows: list[tuple[str, str, float | None]]) -> DataFrame:   # S21
    """Report metrics as a long table (section, metric, value)."""
    return spark.createDataFrame(rows, "section string, metric string, value double")
