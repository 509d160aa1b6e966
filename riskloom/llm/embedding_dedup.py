"""Embedding near-dedup with randomised-rotation binary codes.

*Codes.*  A unit vector o in d dimensions is turned by random orthogonal matrices R and kept as the
signs of its turned coordinates.  With x = sign(R o) / sqrt(d) and the stored correction factor
f = <x, R o>, the estimate <x, R q> / f of <o, q> is unbiased over the rotation, and its error stays
within ``confidence * sqrt((1 - f^2) / (f^2 (d - 1)))`` with a probability that grows with
``confidence`` (RaBitQ, Gao and Long 2024).  The bound of a pair is taken from the tighter of its two sides.

*Candidates.*  The bits of further rotations are cut into segments.  Vectors that agree on a segment
meet in its bucket.  Two vectors at angle t agree on a bit with probability 1 - t/pi; the number of bits
follows the number of vectors (about ``BUCKET`` per bucket) and the number of segments follows from it,
so that a pair exactly at the threshold is found with probability ``recall`` (0.97); closer pairs are
found more surely.  A pair that meets in several buckets counts in the first only: the
segments before that one travel with the vector and are compared.

*Decision.*  In a bucket the estimates and their upper bounds decide which pairs can reach the
threshold; those, and only those, are recomputed exactly in double precision and linked if their
cosine is at least the threshold.  So no link is below it.

Identical vectors are collapsed first and counted.  Buckets are dealt into chunks of at most
``CHUNK`` members and every pair of chunks is one unit of work, so a bucket that holds a third of all vectors
is split, with none of its pairs left out.  Pairs never leave a task: only counts per vector and a
spanning set of links do.

Rows: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (0
links, their own component).  Vectors of different lengths never link.  Rows with the same vec_id are
one vector if equal; otherwise each row has its own links and they share a component.  A null vec_id
takes no part (component null).  Labels and other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, ints, record_batch, written
from riskloom.llm.components import components

BUCKET = 4
CHUNK = 1024
CONFIDENCE = 5.0


def rotations(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """``count`` random orthogonal matrices, as one (count * dim, dim) matrix."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def segment_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a segment, number of segments) for n vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(2, n) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def usable(v: np.ndarray | None) -> bool:
    if v is None or not len(v) or not np.isfinite(v).all():
        return False
    norm = np.linalg.norm(v)
    return bool(norm > 0 and np.isfinite(norm))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (vec_id, cls), classes (cls, copies, vector as bytes of doubles)); cls is the smallest vec_id, null if unusable."""
    def pack(batch: pa.RecordBatch) -> dict:
        out = []
        for v in batch.column(1):
            x = None
            if v.is_valid and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            out.append(x.tobytes() if usable(x) else None)
        return {"vec_id": batch.column(0), "v": out}

    rows = written(arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
                             "vec_id long, v binary", pack), "vectors")
    same = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(
        F.min("vec_id").alias("cls"), F.count_distinct("vec_id").alias("copies"))
    same = written(same, "classes")
    return rows.join(same.select("v", "cls", "copies"), "v", "left").select("vec_id", "cls", "copies"), same


def _segments(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(table, key, cls, copies, v, keys): one row for each segment of a vector; keys are all its segments."""
    def explode(batch: pa.RecordBatch) -> dict:
        raw = [np.frombuffer(v.as_py(), np.float64) for v in batch.column(2)]
        keys = np.zeros((len(raw), tables), np.int32)
        size = np.array([len(v) for v in raw])
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            x = np.stack([raw[i] for i in at])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            # The first rotation is the estimate's; segments take the bits of the others.
            turn = rotations(int(dim), 1 + -(-bits * tables // int(dim)))[int(dim):]
            sign = (x @ turn[:bits * tables].T >= 0).reshape(len(at), tables, bits)
            keys[at] = sign @ (1 << np.arange(bits))
        rep = np.repeat(np.arange(len(raw)), tables)
        take = pa.array(rep)
        packed = pa.array([k.tobytes() for k in keys], pa.binary())
        # Vectors of different lengths do not meet: the length is part of the key.
        return {"table_no": np.tile(np.arange(tables, dtype=np.int32), len(raw)),
                "bucket": keys.ravel().astype(np.int64) | size[rep].astype(np.int64) << 32,
                "cls": batch.column(0).take(take), "copies": batch.column(1).take(take),
                "v": batch.column(2).take(take), "keys": packed.take(take)}

    return arrow_map(classes.select("cls", "copies", "v"),
                     "table_no int, bucket long, cls long, copies long, v binary, keys binary", explode)


def _tile(table: int, a: tuple, b: tuple | None, threshold: float, confidence: float, turn: np.ndarray):
    """Links between the members a and b of a bucket (b None: inside a): link counts of both, and a spanning set."""
    cls, copies, v, keys = a
    other = a if b is None else b
    x, y = v / np.linalg.norm(v, axis=1, keepdims=True), other[2] / np.linalg.norm(other[2], axis=1, keepdims=True)
    dim = x.shape[1]
    xr, yr = x @ turn.T, y @ turn.T
    xs = np.where(xr >= 0, 1.0, -1.0) / math.sqrt(dim)
    ys = np.where(yr >= 0, 1.0, -1.0) / math.sqrt(dim)
    fx, fy = (xs * xr).sum(1), (ys * yr).sum(1)
    ex, ey = (confidence * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, dim - 1))) for f in (fx, fy))
    upper = np.minimum((xs @ yr.T) / fx[:, None] + ex[:, None], (xr @ ys.T) / fy[None, :] + ey[None, :])
    i, j = np.nonzero(upper >= threshold)
    if b is None:
        i, j = i[i < j], j[i < j]
    if table:
        first = ~(keys[i, :table] == other[3][j, :table]).any(1)
        i, j = i[first], j[first]
    exact = np.einsum("ij,ij->i", x[i], y[j])
    i, j = i[exact >= threshold], j[exact >= threshold]
    links_a = np.bincount(i, other[1][j], len(cls)).astype(np.int64)
    links_b = np.bincount(j, copies[i], len(other[0])).astype(np.int64)
    if b is None:
        links_a, links_b = links_a + links_b, links_b[:0]
    spanning = _forest(cls[i], other[0][j])
    return links_a, links_b, spanning


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links a - b, by repeated minimum labels."""
    if not len(a):
        return a, b
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    ca, cb = codes[:len(a)], codes[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ca], label[cb])
        new = label.copy()
        np.minimum.at(new, ca, low)
        np.minimum.at(new, cb, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[apart], nodes[label[apart]]


def _links(segments: DataFrame, threshold: float, confidence: float, chunk: int) -> DataFrame:
    """Rows (cls, links, other): link counts (other null), and links of a spanning set (links 0)."""
    size = segments.groupBy("table_no", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = segments.join(size, ["table_no", "bucket"]).withColumn(
        "chunks", F.ceil(F.col("members") / F.lit(chunk)).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.xxhash64("table_no", "bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"),
        (F.col("chunk") > F.col("other")).alias("right"), (F.col("chunk") == F.col("other")).alias("inner"),
        "table_no", "cls", "copies", "v", "keys")
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    turns: dict[int, np.ndarray] = {}

    def solve(cols: list) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        right, inner, table, cls, copies, v, keys = cols
        if len(cls) < 2:
            return None
        right, table = np.array(right, bool), int(table[0])
        cls, copies = np.array(cls, np.int64), np.array(copies, np.int64)
        v = np.frombuffer(b"".join(v), np.float64).reshape(len(cls), -1)
        keys = np.frombuffer(b"".join(keys), np.int32).reshape(len(cls), -1)
        if v.shape[1] not in turns:
            turns[v.shape[1]] = rotations(v.shape[1], 1)
        left = tuple(c[~right] for c in (cls, copies, v, keys))
        beyond = None if inner[0] else tuple(c[right] for c in (cls, copies, v, keys))
        if beyond is not None and not (len(left[0]) and len(beyond[0])):
            return None
        na, nb, (a, b) = _tile(table, left, beyond, threshold, confidence, turns[v.shape[1]])
        who = left[0] if beyond is None else np.concatenate((left[0], beyond[0]))
        n = np.concatenate((na, nb))
        hit = n > 0
        return (np.concatenate((who[hit], a)), np.concatenate((n[hit], np.zeros(len(a), np.int64))),
                np.concatenate((np.full(int(hit.sum()), -1, np.int64), b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        rows = 0
        for cols in _tiles(batches):
            out = solve(cols)
            if out is not None and len(out[0]):
                found.append(out)
                rows += len(out[0])
                if rows > 50_000:
                    yield _flush(found, schema)
                    found, rows = [], 0
        if found:
            yield _flush(found, schema)

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "cls long, links long, other long")


def _flush(found: list, schema: pa.Schema) -> pa.RecordBatch:
    cls, links, other = (np.concatenate(c) for c in zip(*found, strict=True))
    return record_batch(schema, [cls, links, pa.array(other, mask=links > 0)])


def _tiles(batches: Iterator[pa.RecordBatch]):
    """The columns after ``tile`` for each of its values, from sorted batches."""
    key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        tile = ints(b.column(0))
        cuts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)])).tolist()
        cols = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = [c[lo:hi] for c in cols]
            if key == tile[lo]:
                held = [x + y for x, y in zip(held, part, strict=True)]
                continue
            if held is not None:
                yield held
            key, held = tile[lo], part
    if held is not None:
        yield held


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, confidence: float = CONFIDENCE,
                    chunk: int = CHUNK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows, classes = _classes(vectors)
    rows = written(rows, "vector-classes")
    bits, tables = segment_plan(classes.count(), threshold, recall)
    found = written(_links(_segments(classes, bits, tables), threshold, confidence, chunk), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    twins = rows.where("vec_id <> cls").select(F.col("vec_id").alias("a"), F.col("cls").alias("b"))
    edges = found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")).union(twins)
    groups = components(edges).withColumnRenamed("node", "vec_id")
    out = rows.join(counts, "cls", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
