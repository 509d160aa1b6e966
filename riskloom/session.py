"""Spark session settings shared by the library, the tests and the bench.

The library never depends on a particular session being built here: every
operator takes DataFrames and returns DataFrames.  This module only bundles the
settings the operators were designed for (AQE, UTC session zone, no UI) and the
rule for the lineage-cutting folder.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    # Calendar fields are those of the sheet's wall clock; NTZ values are not
    # shifted, and LTZ round trips happen in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Adaptive execution: coalesces small shuffle partitions, converts joins
    # to broadcast when the measured side is small, splits skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Broadcast only what the code proves small: explicit hints on fixed-size
    # tables and bounded_broadcast (persist, count, then hint).  Size estimates
    # are not a bound: without statistics a join's estimate is the product of
    # its inputs, so the planner would broadcast the *fact* side instead
    # (lineitem, 65 MiB at sf0.1).  AQE's runtime threshold follows this one.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "riskloom",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM.
        conf["spark.driver.memory"] = os.environ.get("RISKLOOM_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder used to cut lineage, as ``spark.checkpoint.dir`` names it.

    Where the setting is unset, a session on a ``local`` master gets a fresh folder, removed when the
    process ends; on any other master executors would each write to their own disk, so that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables.

    It lies in this application's own folder, which ``release_scratch`` removes.
    """
    return os.path.join(ensure_checkpoint_dir(spark), f"run-{spark.sparkContext.applicationId}", name)


def release_scratch(spark: SparkSession) -> bool:
    """Remove the tables this application wrote with ``scratch_path``; call it when their readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, ""))
    return bool(folder.getFileSystem(conf).delete(folder, True))


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Remove one table written with ``scratch_path`` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(conf).delete(folder, True))


def reliable_checkpoint(df):
    """Eager reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_spread(df):
    """``df`` as a written Parquet table in the shared checkpoint folder, which takes a fraction of a checkpoint's disk
    (checkpoints keep whole rows, uncompressed) and is read by columns.  If it has fewer files than the cluster's default
    parallelism (small inputs coalesced by adaptive execution), it is spread round-robin and written again so
    iterative fits use every core; at scale nothing extra happens."""
    spark = df.sparkSession

    def written(rows):
        path = scratch_path(spark, f"kept-{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), path
    out, path = written(df)
    par = spark.sparkContext.defaultParallelism
    if len(out.inputFiles()) < par:
        before, (out, path) = path, written(out.repartition(par))
        drop_scratch(spark, before)
    return out


def at_once(calls: list[Callable], most: int = 8) -> list:
    """The results of ``calls`` in their order; up to ``most`` run side by side, so that one's jobs use cores that another's leave idle."""
    with ThreadPoolExecutor(max(1, min(len(calls), most))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(call)) for call in calls]]
