"""Recent-attack check (T01) and the five-minute alert latch (T02), batch and stream.

Latch rule (D21): per key (region), the first event raises an alert; a later
event raises a new alert iff its time is at least ``last_alert + 300 s``.

Batch twin without a per-key task.  A key may hold a third of all rows, so the
events of one key are never processed in one group.  Events at one instant are
first reduced to the smallest id.  Then:

1. per (key, bucket) group, a bucket being 4096, 1024, 256, 64, 16, 4 or one day, an hour or one latch
   window, the widest that keeps the group small (so that sparse keys make few groups) — the alert chain inside a bucket depends only on the time of its
   first alert, which is one of the events of the bucket's first five minutes (or none).  Next-event
   pointers (``searchsorted``) are doubled until they stand still, which gives every such
   candidate's last alert; runs of candidates with the same last alert are merged into
   one row.  The result is a map from the earliest time an alert may be raised to the last alert;
2. these maps compose: the maps of neighbouring buckets are combined into maps of an hour, a day, 16
   days and so on, a task holding the few children of one span; on the way back down each span hands
   its children the time from which they may raise alerts;
3. per (key, bucket) — with that time, the bucket's alerts are marked.

The stream in ``streaming.latch`` runs this on each micro-batch.  The low-latency form here
is ``applyInPandasWithState`` keyed by region, for streams of few events a region (one task sorts them); the state is the last
alert time.  An event-time timeout drops a key's state once the watermark is
300 s past its last alert, when the state can no longer suppress anything.
Rule for out-of-order input across micro-batches: an event earlier than
``last_alert + 300 s`` never raises an alert, even if it is older than the
latched alert.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from riskloom import constants as K
from riskloom.functions.text import alert_text
from riskloom.operators.filters import recent
from riskloom.operators.joins import bounded_broadcast
from riskloom.session import reliable_checkpoint

MICROS = 1_000_000
NO_ALERT = np.iinfo(np.int64).max


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_micros(c) -> Column:
    """Microseconds since the epoch of a wall-clock (NTZ) time, independent of the session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", _epoch(), c.cast("timestamp_ntz"))


def from_micros(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", c, _epoch())


# ------------------------------------------------------------------ T01

def latest_attack(df: DataFrame, as_of: Column, seconds: int = K.RECENT_SECONDS) -> DataFrame:
    """One row (attack, text, incident_id, incident_time) for the dashboard alert.

    One global aggregation with partial combine: the latest recent row is a
    ``max_by`` over (time, id) restricted to recent rows; no sort, no window.
    """
    is_recent = F.col("incident_time") > as_of - F.make_dt_interval(secs=F.lit(seconds))
    order = F.when(is_recent, F.struct("incident_time", "incident_id"))
    payload = F.struct("enterprise_type", "region", "incident_id", "incident_time")
    agg = df.agg(F.count(F.lit(1)).alias("_n"), F.max_by(payload, order).alias("_last"))
    return agg.select(
        F.col("_last").isNotNull().alias("attack"),
        F.when(F.col("_n") == 0, F.lit(K.NO_DATA))
         .when(F.col("_last").isNull(), F.lit(K.NO_EVENTS))
         .otherwise(alert_text(F.col("_last.enterprise_type"), F.col("_last.region"))).alias("text"),
        F.col("_last.incident_id").alias("incident_id"),
        F.col("_last.incident_time").alias("incident_time"),
    )


def recent_rows(df: DataFrame, as_of: Column, seconds: int = K.RECENT_SECONDS) -> DataFrame:
    return recent(df, as_of, seconds)


# ------------------------------------------------------------------ T02 batch

def _chains(nxt: np.ndarray) -> np.ndarray:
    """Last alert index of the chain from each event; pointers beyond the end stand for none."""
    last = np.where(nxt < len(nxt), nxt, np.arange(len(nxt)))
    while True:
        further = last[last]                  # twice as many alerts on
        if np.array_equal(further, last):
            return last
        last = further


def _phase1(latch_us: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        key, b = pdf["key"].iloc[0], int(pdf["bucket"].iloc[0])
        T = np.sort(pdf["us"].to_numpy(dtype=np.int64))
        m = len(T)
        nxt = np.searchsorted(T, T + latch_us, "left")
        c = int(np.searchsorted(T, b + latch_us, "left"))
        cand = np.arange(min(c, m - 1) + 1)
        last = T[_chains(nxt)[cand]]
        his = T[cand]
        keep = np.r_[last[1:] != last[:-1], True]
        hi, lo = list(his[keep]), list(last[keep])
        if c >= m:
            hi.append(NO_ALERT)
            lo.append(None)
        return pd.DataFrame({"key": key, "bucket": b, "hi": hi, "last": pd.array(lo, dtype="Int64")})
    return fn


_NONE = np.iinfo(np.int64).min            # "no alert" in arrays of last alerts


def _maps(pdf: pd.DataFrame):
    """(start, his, lasts) of the buckets of a group, in order of time."""
    pdf = pdf.sort_values(["bucket", "hi"])
    bucket, his = pdf["bucket"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64)
    lasts = pdf["last"].astype("Int64").fillna(_NONE).to_numpy(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[i]), his[i:j], lasts[i:j]


def _after(lasts: np.ndarray, start: int, his: np.ndarray, own: np.ndarray, latch_us: int) -> np.ndarray:
    """The last alerts behind one more bucket, for the last alerts before it."""
    at = np.searchsorted(his, np.where(lasts == _NONE, start, np.maximum(start, lasts + latch_us)), "left")
    found = np.where(at < len(his), own[np.minimum(at, len(his) - 1)], _NONE)
    return np.where(found == _NONE, lasts, found)


def _compose(latch_us: int):
    """One map for all buckets of a span."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        maps = _maps(pdf)
        _, his, lasts = next(maps)
        for start, h, own in maps:
            lasts = _after(lasts, start, h, own, latch_us)
            keep = np.r_[lasts[1:] != lasts[:-1], True]
            his, lasts = his[keep], lasts[keep]
        last = pd.array([None if v == _NONE else int(v) for v in lasts], dtype="Int64")
        return pd.DataFrame({"key": pdf["key"].iloc[0], "bucket": pdf["parent"].iloc[0], "hi": his, "last": last})
    return fn


def _enter(latch_us: int):
    """The time from which each bucket of a span may raise alerts; ``th`` is that of the span."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        th, last, out = int(pdf["th"].iloc[0]), np.array([_NONE]), []
        for start, his, own in _maps(pdf):
            entry = max(start, th if last[0] == _NONE else int(last[0]) + latch_us)
            out.append((start, entry))
            at = int(np.searchsorted(his, entry, "left"))
            if at < len(his) and own[at] != _NONE:
                last = own[at:at + 1]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "bucket": [b for b, _ in out], "th": [t for _, t in out]})
    return fn


_MAP = "key string, bucket bigint, hi bigint, last bigint"
_ENTRY = "key string, bucket bigint, th bigint"
_SPANS = tuple(h * 3_600 * MICROS for h in (1, 24, 24 * 16, 24 * 256, 24 * 4096, 24 * 65536))
_WIDE = (4, 16, 64, 256, 1024, 4096)      # days of the wide buckets, each of them whole in the spans and in the next


def _entries(maps: DataFrame, latch_us: int, leaf: int) -> DataFrame:
    """(key, bucket, th) for the buckets of ``maps``: up the tree of spans, and down again."""
    low, high = maps.agg(F.min("bucket"), F.max("bucket")).first()

    def within(level: DataFrame, span: int) -> DataFrame:
        return level.withColumn("parent", (F.floor(F.col("bucket") / F.lit(span)) * F.lit(span)).cast("bigint"))

    spans = [s for i, s in enumerate(_SPANS) if s > leaf and (i == 0 or _SPANS[i - 1] <= (high or 0) - (low or 0))]
    levels = [maps]
    for span in spans:
        levels.append(reliable_checkpoint(within(levels[-1], span).groupBy("key", "parent").applyInPandas(_compose(latch_us), _MAP)))
    entry = levels[-1].withColumn("th", F.lit(_NONE)).groupBy("key").applyInPandas(_enter(latch_us), _ENTRY)  # a few spans a key
    for span, level in zip(reversed(spans), reversed(levels[:-1]), strict=True):
        above = entry.withColumnRenamed("bucket", "parent")
        entry = within(level, span).join(above, ["key", "parent"]).groupBy("key", "parent").applyInPandas(_enter(latch_us), _ENTRY)
    return entry


def _phase3(latch_us: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        T = pdf["us"].to_numpy(dtype=np.int64)
        m = len(T)
        nxt = np.searchsorted(T, T + latch_us, "left")
        s = int(np.searchsorted(T, int(pdf["th"].iloc[0]), "left"))
        idx = []
        while s < m:
            idx.append(s)
            s = int(nxt[s])
        return pdf.iloc[idx][["key", "us", "incident_id", "enterprise_type"]]
    return fn


def _widths(days: DataFrame, latch_us: int, max_group_rows: int, wide_group_rows: int) -> DataFrame:
    """(key, day, _w) for (key, day, _n events): the width of the bucket that each day of a key is in.

    The days of a bucket share its count and those of all wider ones around it, so they get the same width.
    One shuffle, by (key, widest bucket), serves all the sums.
    """
    day, n, names = 86_400 * MICROS, F.col("_n"), [f"_d{w}" for w in reversed(_WIDE)]
    for w, name in zip(reversed(_WIDE), names, strict=True):
        days = days.withColumn(name, F.floor(F.col("day") / F.lit(w)).cast("bigint"))
    days = days.repartition("key", names[0])
    width = F.when(n > 24 * max_group_rows, F.lit(latch_us)).when(n > max_group_rows, F.lit(3_600 * MICROS)).otherwise(F.lit(day))
    for i, w in enumerate(_WIDE):
        sums = F.sum("_n").over(Window.partitionBy("key", *names[:len(names) - i]))
        days = days.withColumn(f"_n{w}", sums)
        width = F.when(F.col(f"_n{w}") <= min(wide_group_rows, max_group_rows), F.lit(w * day)).otherwise(width)
    return days.select("key", "day", width.alias("_w"))


def latch_alerts(df: DataFrame, key: str = "region", latch_seconds: int = K.ALERT_LATCH_SECONDS,
                 max_group_rows: int = 2_000_000, wide_group_rows: int = 20_000) -> DataFrame:
    """Alerts (key, alert_time, incident_id, enterprise_type, alert_text) by the latch rule.

    Buckets are one day wide; where a (key, day) has more than ``max_group_rows`` events they are
    one hour wide, and where it has more than 24 times as many, one latch window.  Days in a row are one bucket of up to
    4096 days while it has at most ``wide_group_rows`` events: a group costs some milliseconds, however few its rows.
    All widths are multiples of the window, which the chain argument needs.
    """
    L = latch_seconds * MICROS
    day, hour = 86_400 * MICROS, 3_600 * MICROS
    if hour % L:
        raise ValueError("the latch window must divide one hour")
    timed = df.where(F.col("incident_time").isNotNull()).withColumn("key", F.col(key)).withColumn("us", to_micros("incident_time"))
    of_day = F.floor(F.col("us") / F.lit(day)).cast("bigint").alias("day")
    # Events, not instants, are counted: that needs no shuffle of the events, and only the widths depend on it.
    widths = bounded_broadcast(_widths(timed.groupBy("key", of_day).agg(F.count(F.lit(1)).alias("_n")), L, max_group_rows, wide_group_rows))
    at_once = F.min(F.struct("incident_id", "enterprise_type")).alias("_first")
    ev = timed.groupBy("key", "us").agg(at_once).select("key", "us", "_first.incident_id", "_first.enterprise_type", of_day)
    # An explicit partition count: adaptive execution would coalesce this small-looking
    # shuffle into very few tasks, but the grouped phases below are compute-heavy.  Both
    # grouped phases reuse this one hash partitioning on (key, bucket).
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ev = ev.join(widths, ["key", "day"]) \
           .withColumn("bucket", (F.floor(F.col("us") / F.col("_w")) * F.col("_w")).cast("bigint")) \
           .drop("day", "_w").repartition(parts, "key", "bucket")
    tables = reliable_checkpoint(ev.select("key", "bucket", "us").groupBy("key", "bucket").applyInPandas(_phase1(L), _MAP))
    entry = _entries(tables, L, widths.agg(F.min("_w")).first()[0] or day)
    marked = ev.join(entry, ["key", "bucket"]).groupBy("key", "bucket").applyInPandas(
        _phase3(L), "key string, us bigint, incident_id bigint, enterprise_type string")
    return marked.select(F.col("key").alias(key), from_micros("us").alias("alert_time"), "incident_id",
                         "enterprise_type", alert_text("enterprise_type", F.col("key")).alias("alert_text"))


# ------------------------------------------------------------------ T02 stream

_STATE_SCHEMA = "last_us long"
_OUT_SCHEMA = "region string, us long, incident_id long, enterprise_type string"


def _stream_fn(latch_us: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["us", "incident_id"], kind="stable")
        T = pdf["us"].to_numpy(dtype=np.int64)
        m = len(T)
        nxt = np.searchsorted(T, T + latch_us, "left")
        s = 0 if last is None else int(np.searchsorted(T, last + latch_us, "left"))
        idx = []
        while s < m:
            idx.append(s)
            s = int(nxt[s])
        if idx:
            last = int(T[idx[-1]])
        if last is not None:
            state.update((last,))
            wm = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(last // 1000 + latch_us // 1000, wm + 1))
        out = pdf.iloc[idx]
        yield pd.DataFrame({"region": key[0], "us": out["us"].to_numpy(), "incident_id": out["incident_id"].to_numpy(),
                            "enterprise_type": out["enterprise_type"].to_numpy()})
    return fn


def latch_alerts_stream(stream: DataFrame, latch_seconds: int = K.ALERT_LATCH_SECONDS,
                        watermark: str = "10 minutes") -> DataFrame:
    """Streaming alerts keyed by region (append mode, event-time timeout)."""
    ev = (stream.where(F.col("incident_time").isNotNull())
          .withColumn("event_ts", F.col("incident_time").cast("timestamp"))
          .withWatermark("event_ts", watermark)
          .select("region", "event_ts", to_micros("incident_time").alias("us"), "incident_id", "enterprise_type"))
    out = ev.groupBy("region").applyInPandasWithState(
        _stream_fn(latch_seconds * MICROS), _OUT_SCHEMA, _STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
    return out.select("region", from_micros("us").alias("alert_time"), "incident_id", "enterprise_type",
                      alert_text("enterprise_type", "region").alias("alert_text"))
