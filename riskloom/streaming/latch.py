"""The five-minute alert latch over a stream, equal to the batch twin for input that is out of order.

Each micro-batch goes through ``foreachBatch``.  Its events, and those held back before, are settled up to the
watermark, the greatest event time seen less ``delay``; later ones are held back, since an earlier event
may still come and raise its alert first.  Settled events are in order across micro-batches, so all
the state that a region needs is its last alert: events less than a latch window after it cannot raise
one, and the rest run through the batch twin (``alerts.latch_alerts``), in which no region is ever in one task.

State is three tables for each micro-batch under ``state``: ``latch`` (region, last alert; one row a region),
``held`` (events above the watermark, at most ``delay`` of input) and ``clock`` (the watermark; one row).
A micro-batch reads the state of the one before it and replaces its own, and its alerts are one
partition of the sink, so a micro-batch that is repeated after a failure gives the same again.

Events that come after the watermark has passed them are never settled; they are kept in the partitioned table
``late`` under ``state``.  Events without a time are left out.  ``flush`` settles what is held back when a
stream has ended.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.joins import bounded_broadcast
from riskloom.streaming.alerts import MICROS, latch_alerts, to_micros

_EVENT = "region string, incident_time timestamp_ntz, incident_id bigint, enterprise_type string"
_LATCH = "region string, last_us bigint"
_CLOCK = "watermark bigint"
_FLUSHED = (1 << 62)


def _folder(state: str, name: str, batch_id: int) -> str:
    return os.path.join(state, name, f"{batch_id:018d}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return bool(p.getFileSystem(conf).exists(p))


def _state(spark: SparkSession, state: str, batch_id: int) -> tuple[DataFrame, DataFrame, int | None]:
    """(latch, held, watermark) behind micro-batch ``batch_id``; empty before the first."""
    if batch_id < 0 or not _exists(spark, _folder(state, "clock", batch_id)):
        return spark.createDataFrame([], _LATCH), spark.createDataFrame([], _EVENT), None
    clock = spark.read.schema(_CLOCK).parquet(_folder(state, "clock", batch_id)).first()[0]
    return (spark.read.schema(_LATCH).parquet(_folder(state, "latch", batch_id)),
            spark.read.schema(_EVENT).parquet(_folder(state, "held", batch_id)), clock)


def settle(batch: DataFrame, batch_id: int, sink: str, state: str, delay_seconds: int = 600,
           latch_seconds: int = K.ALERT_LATCH_SECONDS, end: bool = False) -> None:
    """Process one micro-batch: write its alerts and the state behind it; ``end`` settles everything."""
    spark = batch.sparkSession
    latch, held, before = _state(spark, state, batch_id - 1)
    events = batch.where(F.col("incident_time").isNotNull()).select(
        "region", F.col("incident_time").cast("timestamp_ntz").alias("incident_time"),
        F.col("incident_id").cast("bigint").alias("incident_id"), "enterprise_type").withColumn("us", to_micros("incident_time"))
    passed = F.lit(False) if before is None else F.col("us") < before
    seen = events.agg(F.max("us")).first()[0]
    known = [x for x in (before, None if seen is None else seen - delay_seconds * MICROS) if x is not None]
    watermark = _FLUSHED if end else max(known) if known else None
    late = events.where(passed).drop("us")
    if before is not None:
        _write(late.withColumn("batch_id", F.lit(batch_id).cast("bigint")), os.path.join(state, "late"), "batch_id")
    open_ = events.where(~passed).unionByName(held.withColumn("us", to_micros("incident_time")))
    due = F.lit(False) if watermark is None else F.col("us") < watermark

    free = F.col("last_us").isNull() | (F.col("us") >= F.col("last_us") + latch_seconds * MICROS)
    settled = open_.where(due).join(bounded_broadcast(latch), "region", "left").where(free).drop("us", "last_us")
    alerts = latch_alerts(settled, latch_seconds=latch_seconds)
    _write(alerts.withColumn("batch_id", F.lit(batch_id).cast("bigint")), sink, "batch_id")
    raised = spark.read.schema(alerts.schema).parquet(os.path.join(sink, f"batch_id={batch_id}")) \
        if _exists_partition(spark, sink, batch_id) else alerts.limit(0)
    newest = raised.groupBy("region").agg(F.max(to_micros("alert_time")).alias("last_us"))
    latch.unionByName(newest).groupBy("region").agg(F.max("last_us").alias("last_us")) \
        .write.mode("overwrite").parquet(_folder(state, "latch", batch_id))
    open_.where(~due).drop("us").write.mode("overwrite").parquet(_folder(state, "held", batch_id))
    # The clock is written last: it marks the state of this micro-batch as complete.
    spark.createDataFrame([(watermark,)], _CLOCK).write.mode("overwrite").parquet(_folder(state, "clock", batch_id))


def _write(df: DataFrame, path: str, partition: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _exists_partition(spark: SparkSession, sink: str, batch_id: int) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(sink, f"batch_id={batch_id}")
    return bool(p.getFileSystem(conf).exists(p))


def run(stream: DataFrame, sink: str, state: str, checkpoint: str, delay_seconds: int = 600,
        latch_seconds: int = K.ALERT_LATCH_SECONDS, available_now: bool = True) -> None:
    """Run a stream of incidents through the latch until its input is used up (or for ever)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        settle(batch.persist(), batch_id, sink, state, delay_seconds, latch_seconds)
        batch.unpersist()

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    (w.trigger(availableNow=True) if available_now else w).start().awaitTermination()


def last_batch(spark: SparkSession, state: str) -> int:
    """The number of the last complete micro-batch, -1 if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(state, "clock")
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return -1
    return max((int(s.getPath().getName()) for s in fs.listStatus(root)
                if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), default=-1)


def flush(spark: SparkSession, sink: str, state: str, latch_seconds: int = K.ALERT_LATCH_SECONDS) -> None:
    """Settle all events held back; for the end of a stream.  What comes after it is late."""
    nothing = spark.createDataFrame([], _EVENT)
    settle(nothing, last_batch(spark, state) + 1, sink, state, latch_seconds=latch_seconds, end=True)


def late_events(spark: SparkSession, state: str) -> DataFrame:
    """Events that came too late to be settled, with their ``batch_id``."""
    path = os.path.join(state, "late")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], _EVENT + ", batch_id bigint")
    return spark.read.schema(_EVENT + ", batch_id bigint").parquet(path)
