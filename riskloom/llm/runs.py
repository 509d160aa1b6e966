"""Range-partitioned, sorted streams over rows (h1, h2, doc, pos): what repeats, without one task per key.

Rows are range-partitioned by (h1, h2, doc, pos), so a key held by a third of all rows spreads over as
many partitions as its rows need.  Each task streams its sorted rows and decides every key that lies
wholly inside its partition.  A key that touches the first or last run of a partition may go on next
door; its undecided rows leave the task marked as *edge* and are settled by a small aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ints, record_batch, tidy, written

DROP, EDGE, MARK = 0, 1, 2


def _starts(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Indices at which a new key begins; 0 is always one."""
    change = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def _sorted(rows: DataFrame, more: list[str]) -> DataFrame:
    keys = ["h1", "h2", "doc", "pos", *more]
    return rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)


def _stream(rows: DataFrame, more: list[str], decide) -> DataFrame:
    """decide(iterator of column lists) yields (state, column lists)."""
    names = ["h1", "h2", "doc", "pos", *more]
    schema = "state int, " + ", ".join(f"{n} long" for n in names)
    target = pa.schema([("state", pa.int32()), *((n, pa.int64()) for n in names)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([ints(b.column(i)) for i in range(len(names))] for b in batches if b.num_rows)
        for state, out in decide(columns):
            if len(out[0]):
                yield record_batch(target, [np.full(len(out[0]), state, np.int32), *out])

    return _sorted(rows, more).mapInArrow(run, schema)


def _later(batches):
    """Rows that differ from the first row of their key by (doc, pos).

    The first rows of the partition's first and last runs are edges: only they can be the earliest of a
    key that also stands next door, or fail to be.
    """
    key, head, first, lead = None, None, True, None
    for cols in batches:
        h1, h2, doc, pos = cols[:4]
        starts = _starts(h1, h2)
        goes_on = key == (h1[0], h2[0])
        size = np.diff(np.append(starts, len(h1)))
        head_doc, head_pos = doc[starts], pos[starts]
        if goes_on:
            head_doc[0], head_pos[0] = head
        later = (doc != np.repeat(head_doc, size)) | (pos != np.repeat(head_pos, size))
        edge_until = 0
        if first:
            new = starts[1:] if key is None or goes_on else starts
            edge_until = int(new[0]) if len(new) else len(h1)
            yield EDGE, [c[:edge_until][~later[:edge_until]] for c in cols]
            first = edge_until == len(h1)
        yield DROP, [c[later] for c in cols]
        key, head = (h1[-1], h2[-1]), (head_doc[-1], head_pos[-1])
        if not first and (not goes_on or len(starts) > 1):
            lead = [c[starts[-1]:starts[-1] + 1] for c in cols]
    if lead is not None:
        yield EDGE, lead


def later_occurrences(rows: DataFrame, more: list[str]) -> DataFrame:
    """Rows (h1, h2, doc, pos, *more) that are not the earliest by (doc, pos) of their key."""
    out = written(_stream(rows, more, _later), "later")
    edge = out.where(F.col("state") == EDGE)
    # At most two keys of a partition are edges, so this table has at most 2 x partitions rows.
    heads = edge.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("head"))
    settled = edge.join(F.broadcast(heads), ["h1", "h2"]).where(F.struct("doc", "pos") != F.col("head"))
    cols = ["h1", "h2", "doc", "pos", *more]
    return out.where(F.col("state") == DROP).select(cols).unionByName(settled.select(cols))


def _frequent(min_docs: int):
    def decide(batches):
        first, pend, hot = True, None, None
        for cols in batches:
            if hot is not None:  # the last run is known to be frequent: pass its rows on
                same = (cols[0] == hot[0]) & (cols[1] == hot[1])
                n = len(same) if same.all() else int(np.argmin(same))
                yield DROP, [c[:n] for c in cols]
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                hot = None
            if pend is not None:
                cols = [np.concatenate((p, c)) for p, c in zip(pend, cols, strict=True)]
                pend = None
            starts = _starts(cols[0], cols[1])
            doc = cols[2]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = doc[1:] != doc[:-1]
            fresh[starts] = True
            docs = np.add.reduceat(fresh.astype(np.int64), starts)
            size = np.diff(np.append(starts, len(doc)))
            keep = docs >= min_docs
            whole = keep.copy()
            whole[-1] = False
            take = np.repeat(whole, size)
            yield DROP, [c[take] for c in cols]
            if first and len(starts) > 1:
                head = [c[:size[0]] for c in cols]
                yield (MARK, [c[:1] for c in head]) if keep[0] else (EDGE, head)
                first = False
            tail = [c[starts[-1]:] for c in cols]
            if keep[-1]:
                yield DROP, tail
                yield MARK, [c[:1] for c in tail]
                hot, first = (tail[0][0], tail[1][0]), False
            else:
                pend = tail
        if pend is not None:
            yield EDGE, pend
    return decide


def frequent_occurrences(rows: DataFrame, min_docs: int, more: list[str]) -> DataFrame:
    """Rows (h1, h2, doc, pos, *more) whose key occurs in at least ``min_docs`` different ``doc``."""
    out = written(_stream(rows, more, _frequent(min_docs)), "frequent")
    edge = out.where(F.col("state") != DROP)
    # Edge keys: at most two for each partition.
    hot = edge.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("docs"), F.max("state").alias("top")).where(
        (F.col("docs") >= min_docs) | (F.col("top") == MARK)).select("h1", "h2")
    settled = edge.where(F.col("state") == EDGE).join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    cols = ["h1", "h2", "doc", "pos", *more]
    return out.where(F.col("state") == DROP).select(cols).unionByName(settled.select(cols))
