"""The latch over a stream: out-of-order input, late events, repeated micro-batches, and the tree of buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.streaming import alerts as AL
from riskloom.streaming import jobs as J
from riskloom.streaming import latch as LT
from test_streaming import BASE, INC, brute


def events(spark, rows):
    """(id, region, seconds) as incidents."""
    return spark.createDataFrame([(i, "T", "1", 1, 1, 1, k, None, None if s is None else BASE + dt.timedelta(seconds=s)) for i, k, s in rows], INC)


def ids(df):
    return sorted(r.incident_id for r in df.collect())


@pytest.mark.parametrize("max_rows", [1, 40, 2_000_000])
def test_tree_over_long_spans(spark, max_rows):
    """One region with bursts and gaps over two years, in buckets of a window, an hour and a day."""
    rng = random.Random(max_rows)
    times = [rng.randrange(86400) for _ in range(300)] + [86400 * 3 + 60 * rng.randrange(2000) for _ in range(300)]
    times += [86400 * rng.randrange(700) + rng.randrange(3000) for _ in range(300)] + [-86400 * 20 + 17 * i for i in range(200)]
    rows = [(i, "hot", s) for i, s in enumerate(times)] + [(5000 + i, f"r{i % 3}", 400 * i) for i in range(30)]
    assert ids(AL.latch_alerts(events(spark, rows), max_group_rows=max_rows)) == sorted(brute(rows))


def test_sparse_days_share_a_group(spark, monkeypatch):
    """Groups follow the number of events, not of days: 600 days of a few events each are one group a region or two."""
    rows = [(i, f"r{i % 3}", 86400 * (i // 3 - 200) + 7 * i) for i in range(1800)] + [(9000 + i, "r0", 100 * i) for i in range(50)]
    seen, entries = [], AL._entries
    monkeypatch.setattr(AL, "_entries", lambda maps, *a: seen.append(maps.select("key", "bucket").distinct().count()) or entries(maps, *a))
    assert ids(AL.latch_alerts(events(spark, rows))) == sorted(brute(rows))
    assert seen[0] <= 6


@pytest.mark.parametrize("wide_rows", [1, 3, 12, 60, 250])
def test_buckets_of_many_widths_in_one_region(spark, wide_rows):
    """Dense and sparse stretches around the epoch and later, with chains across the edges of the buckets."""
    rng = random.Random(wide_rows)
    epoch = -19723 * 86400                                                    # BASE is 2024-01-01
    times = [epoch + 86400 * rng.randrange(-5000, 5000) + rng.randrange(86400) for _ in range(150)]
    times += [epoch + 86400 * d + s for d in (-4096, -16, 0, 4, 64, 4096) for s in range(-900, 900, 130)] + [rng.randrange(40000) for _ in range(200)]
    rows = [(i, f"r{i % 2}", s) for i, s in enumerate(times)] + [(7000, None, 0), (7001, "r0", None)]
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    assert ids(AL.latch_alerts(events(spark, rows), wide_group_rows=wide_rows)) == sorted(brute(known))


def test_out_of_order_stream_of_one_region_equals_batch(spark):
    rng = random.Random(4)
    rows = [(i, "hot", rng.randrange(6 * 3600)) for i in range(500)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(1500))          # up to 25 minutes out of order
    src, sink, state, ck = (J.fresh(spark, n) for n in ("src", "sink", "state", "ck"))
    for lo in range(0, 500, 125):
        events(spark, arrival[lo:lo + 125]).write.mode("append").parquet(src)
        LT.run(spark.readStream.schema(INC).parquet(src), sink, state, ck, delay_seconds=1500)
    LT.flush(spark, sink, state)
    out = J.read_sink(spark, sink)
    assert out.select("batch_id").distinct().count() > 2
    assert ids(out) == sorted(brute(rows)) and LT.late_events(spark, state).count() == 0
    assert ids(out) == ids(AL.latch_alerts(events(spark, rows)))


def test_late_events_and_repeated_micro_batches(spark):
    sink, state = J.fresh(spark, "sink"), J.fresh(spark, "state")
    first = [(1, "a", 0), (2, "a", 100), (3, "b", 50), (4, "a", 5000), (5, "a", None)]
    for _ in range(2):
        LT.settle(events(spark, first), 0, sink, state)
    assert ids(J.read_sink(spark, sink)) == [1, 3]                            # 5000 s is held back
    second = [(6, "a", 10), (7, "b", 4390), (8, "a", 4395), (9, None, 9000)]  # 6 and 7 are below the watermark of 4400 s
    for _ in range(2):
        LT.settle(events(spark, second), 1, sink, state)
    assert ids(J.read_sink(spark, sink)) == [1, 3, 4]
    assert ids(LT.late_events(spark, state)) == [6, 7, 8]
    LT.settle(events(spark, []), 2, sink, state)
    LT.flush(spark, sink, state)
    assert ids(J.read_sink(spark, sink))[:3] == [1, 3, 4] and LT.last_batch(spark, state) == 3


def test_state_is_one_row_a_region(spark):
    sink, state = J.fresh(spark, "sink"), J.fresh(spark, "state")
    rows = [(i, f"r{i % 4}", 30 * i) for i in range(400)]
    LT.settle(events(spark, rows), 0, sink, state, delay_seconds=0)
    LT.settle(events(spark, [(1000 + i, "r0", 12000 + 400 * i) for i in range(5)]), 1, sink, state, delay_seconds=0)
    latch, held, clock = LT._state(spark, state, 1)
    assert latch.count() == 4 and held.count() == 1 and clock == (1704067200 + 13600) * AL.MICROS
    want = brute(rows + [(1000 + i, "r0", 12000 + 400 * i) for i in range(5)])
    LT.flush(spark, sink, state)
    assert ids(J.read_sink(spark, sink)) == sorted(want)
    assert LT.late_events(spark, state).where(F.lit(True)).count() == 0
