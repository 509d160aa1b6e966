"""The load command: read both sheets, upsert last-wins into the stored tables, audit.

Read → typed projections → one aggregation per table on its key → one
partitioned write.  The only shuffle is on the upsert key.  The stored tables
are versioned snapshots under ``store``.  A load reads the newest version as
the oldest upsert batch, writes the tables of a new one and, when both are
complete, adds that version's marker, a new folder under ``_versions`` that is
never changed again; Spark's ``_SUCCESS`` file in it commits the version.  A
load that fails anywhere leaves the newest version as it was.  Only a store
without any version is a first load; every other failure to read one is
raised.  Inside a sheet the last row of a key wins.  Re-loading the same sheet
is idempotent.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources import sheets as SH
from riskloom.sources import sinks as SK
from riskloom.sources.upsert import upsert_last_wins

INCIDENT_KEY = ["enterprise_code", "incident_time"]
SEQUENCE = "sheet_row"


def versions(spark: SparkSession, store: str) -> list[str]:
    """Names of the committed versions, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(os.path.join(store, "_versions"))
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(f.getName() for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def current_version(spark: SparkSession, store: str) -> str | None:
    """The newest committed version; None only if there is none."""
    found = versions(spark, store)
    return found[-1] if found else None


def tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame] | None:
    """(threats, incidents) of the current snapshot, or None before the first load."""
    v = current_version(spark, store)
    if v is None:
        return None
    return (spark.read.parquet(os.path.join(store, f"threats-{v}")),
            SK.read_incident_table(spark, os.path.join(store, f"incidents-{v}")))


def load(spark: SparkSession, threats_sheet: str, incidents_sheet: str, store: str) -> DataFrame:
    """Load both sheets into a new snapshot under ``store``; return the audit counts."""
    last = current_version(spark, store)
    old = tables(spark, store) if last else None
    thr_batches = ([old[0]] if old else []) + [SH.read_threat_sheet(spark, threats_sheet, sequence=SEQUENCE)]
    inc_batches = ([old[1]] if old else []) + [SH.read_incident_sheet(spark, incidents_sheet, sequence=SEQUENCE)]
    threats = upsert_last_wins(thr_batches, ["threat_id"], [SEQUENCE], drop=(SEQUENCE,))
    incidents = upsert_last_wins(inc_batches, INCIDENT_KEY, [SEQUENCE], drop=(SEQUENCE,))
    v = f"{int(last.split('-')[0]) + 1 if last else 1:09d}-{uuid.uuid4().hex[:12]}"
    SK.write_threat_table(threats, os.path.join(store, f"threats-{v}"))
    SK.write_incident_table(incidents, os.path.join(store, f"incidents-{v}"))
    spark.createDataFrame([(v,)], "value string").write.text(os.path.join(store, "_versions", v))
    thr, inc = tables(spark, store)
    return SK.load_audit(threats=thr, incidents=inc)
