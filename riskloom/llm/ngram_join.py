"""Exact Jaccard self-join of word-shingle sets in a metric space, for linked components.

The Jaccard distance d = 1 - |A & B| / |A | B| is a metric, so pivots and the triangle inequality can
confine which documents have to meet.  With ``eps = 1 - threshold``:

1. *Where pivots come from.*  In a text corpus nearly all distances are 1, and a Voronoi split around
   sampled pivots would replicate every such document into every region (1 <= 1 + 2 eps).  Pivots are
   therefore taken where documents are dense.  Shingle hashes are dealt to ``m`` segments by their
   value, ``m`` being fixed for each class of set sizes.  Sets at distance <= eps differ in at most
   k = floor(n * 3/17) shingles (threshold 0.85), so among any k + 1 segments of a document at least
   one is the same in its partner.  A document publishes its segments with at least t shingles, t
   being the largest number that leaves it k + 1 of them; of two linked documents the one with the
   larger t has an unchanged segment that both publish.  Documents that publish the same segment form
   a neighbourhood; its member with the most shared segments is its pivot.  No linked pair is missed.
2. *Voronoi regions.*  Every document meets the pivots of its neighbourhoods, exactly.  Those within
   eps of a pivot form the core of its region and are linked through it: for components nothing inside
   one core needs another comparison.
3. *Windows.*  A member x outside the core can only be linked to members y with
   |d(x, p) - d(y, p)| <= eps.  So what is left of a region is its outer members plus the core members
   at least ``min d(outer) - eps`` away: the replicated boundary documents.
4. *Recursion.*  Regions that are too heavy for one task get new pivots; a member goes to the region
   of its nearest pivot and, by the window d(x, q) <= d(x, nearest) + 2 eps, into those of others.
   This repeats while regions shrink.  What no longer shrinks (dense groups) is dealt into chunks of a
   bounded weight, and every pair of chunks is joined exactly by one task: no member is dropped.

Rows: a null or empty text, or one without words, has an empty set and no links.  Rows with the same
doc_id are one document that has the links of each of its texts.  A row without doc_id takes part in
nothing and has a null component.  Identical sets are collapsed to their smallest doc_id first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import (arrow_map, discard, ints, likely_in, mix64, shingle_set, shuffled, text_bytes, tidy,
                                 with_likely, written)
from riskloom.llm.components import components

CHUNK_SHINGLES = 1 << 19
PIVOTS = 8
MAX_LEVELS = 3


class Threshold:
    """Integer arithmetic of ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.eps = 1 - percent / 100
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
        self.lows = np.array(lows, np.int64)

    def most_changes(self, n: int) -> int:
        """The largest symmetric difference a set of n shingles has with a linked one."""
        return n * (100 - self.percent) // self.percent

    def classes(self, n: int) -> range:
        """Size classes that the smaller set of a linked pair with a set of n shingles can be in, up to n's own."""
        low, high = np.searchsorted(self.lows, [-(-n * self.percent // 100), n], "right") - 1
        return range(int(low), int(high) + 1)

    def segments(self, size_class: int) -> int:
        largest = (int(self.lows[size_class + 1]) - 1) * 100 // self.percent
        k = self.most_changes(largest)
        return 1 if k == 0 else k * 13 // 10 + 4

    def linked(self, inter, union):
        return 100 * inter >= self.percent * union


def published(shingles: np.ndarray, limits: Threshold) -> np.ndarray:
    """64-bit names of the segments that a document publishes."""
    n = len(shingles)
    if n == 0:
        return np.empty(0, np.uint64)
    mixed, names = mix64(shingles), []
    need = limits.most_changes(n)
    for c in limits.classes(n):
        m = limits.segments(c)
        part = (shingles % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=m)
        full = np.flatnonzero(counts)
        sums = np.zeros(m, np.uint64)
        sums[full] = np.add.reduceat(mixed[order], np.concatenate(([0], np.cumsum(counts[full])[:-1])))
        t = int(np.partition(counts, m - 1 - need)[m - 1 - need]) if need < m else 0
        chosen = np.flatnonzero(counts >= t).astype(np.uint64)
        salt = np.uint64(c) << np.uint64(40)
        names.append(mix64(sums[chosen.astype(np.int64)] ^ mix64(chosen + salt + np.uint64(1))))
    return np.concatenate(names)


def _sketches(docs: DataFrame, width: int, limits: Threshold) -> DataFrame:
    def sketch(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return {"doc_id": batch.column(0), "n_shingles": np.array([len(s) for s in sets], np.int64), "set_key": keys,
                "segments": [published(s, limits).tobytes() for s in sets]}

    return arrow_map(docs.select("doc_id", text_bytes().alias("text")),
                     "doc_id long, n_shingles long, set_key binary, segments binary", sketch)


def _publishers(sketches: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, segments) of representatives.  Only rows whose doc_id may be that of a copy travel to be told apart."""
    told = with_likely(sketches.where("doc_id IS NOT NULL").select("doc_id", "segments"), "doc_id",
                       rows.where("doc_id <> group_rep").select("doc_id"), "copy")
    unsure = told.where("copy").join(shuffled(reps.withColumnRenamed("doc", "doc_id")), "doc_id", "left_semi")
    return told.where("NOT copy").unionByName(unsure).drop("copy")


def _neighbourhoods(sketches: DataFrame) -> DataFrame:
    """(segment, doc) of the segments that at least two documents publish."""
    def spread(batch: pa.RecordBatch) -> dict:
        parts = [np.frombuffer(s.as_py(), np.int64) for s in batch.column(1)]
        doc = np.repeat(ints(batch.column(0)), [len(p) for p in parts])
        return {"segment": np.concatenate(parts) if parts else [], "doc": doc}

    rows = arrow_map(sketches, "segment long, doc long", spread)

    @tidy
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows in, the rows of segments with two or more documents out; holds one row between batches."""
        last, last_open = None, False  # the previous batch's last row; whether it still waits for a partner
        for b in batches:
            if not b.num_rows:
                continue
            seg, doc = ints(b.column(0)), ints(b.column(1))
            if last is not None:
                seg, doc = np.append(last[0], seg), np.append(last[1], doc)
            same = seg[1:] == seg[:-1]
            fresh = np.concatenate(([True], ~(same & (doc[1:] == doc[:-1]))))
            carried = last is not None
            waits = last_open
            s, d = seg[fresh], doc[fresh]
            same = s[1:] == s[:-1]
            out = np.zeros(len(s), bool)
            out[1:] |= same
            out[:-1] |= same
            if carried and not waits:
                out[0] = False  # it has been passed on already
            last = (s[-1:], d[-1:])
            last_open = not (out[-1] or (len(s) == 1 and carried and not waits))
            yield pa.RecordBatch.from_arrays([pa.array(s[out]), pa.array(d[out])], names=["segment", "doc"])

    return (rows.repartition("segment").sortWithinPartitions("segment", "doc")
            .mapInArrow(shared, "segment long, doc long"))


def _with_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, set) of the documents in ``wanted``; a set is its sorted hashes as bytes."""
    def build(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
        return {"doc": batch.column(0), "n": np.array([len(s) for s in sets], np.int64), "set": [s.tobytes() for s in sets]}

    text = docs.select(F.col("doc_id").alias("doc"), text_bytes().alias("text"))
    return arrow_map(likely_in(text, "doc", wanted).join(shuffled(wanted), "doc", "left_semi"), "doc long, n long, set binary", build)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(region, pivot, doc, n, inter, union) for rows (region, pivot, doc).

    A pivot's row with itself is known without its set, so no set travels for it.  Of several texts of a pivot
    each meets the other documents, so its rows with itself need only say that it is there.
    """
    own = pairs.where("doc = pivot").join(shuffled(sets.select("doc", "n")), "doc").select(
        "region", "pivot", "doc", "n", F.col("n").alias("inter"), F.col("n").alias("union"))
    both = pairs.where("doc <> pivot").join(shuffled(sets), "doc").join(
        shuffled(sets.select(F.col("doc").alias("pivot"), F.col("set").alias("pivot_set"))), "pivot")

    def measure(batch: pa.RecordBatch) -> dict:
        inter, union = [], []
        for a, b in zip(batch.column(4), batch.column(5), strict=True):
            x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            i = len(np.intersect1d(x, y, assume_unique=True))
            inter.append(i)
            union.append(len(x) + len(y) - i)
        return {"region": batch.column(0), "pivot": batch.column(1), "doc": batch.column(2), "n": batch.column(3),
                "inter": np.array(inter, np.int64), "union": np.array(union, np.int64)}

    return arrow_map(both.select("region", "pivot", "doc", "n", "set", "pivot_set"),
                     "region long, pivot long, doc long, n long, inter long, union long", measure).unionByName(own)


def _leftover(measured: DataFrame, limits: Threshold) -> DataFrame:
    """(region, doc, n, d): outer members, and core members inside their window."""
    d = measured.select("region", "doc", "n", (1 - F.col("inter") / F.col("union")).alias("d"),
                        limits.linked(F.col("inter"), F.col("union")).alias("core"))
    near = d.where(~F.col("core")).groupBy("region").agg(F.min("d").alias("nearest"))
    kept = d.join(near, "region").where(~F.col("core") | (F.col("d") >= F.col("nearest") - limits.eps - 1e-9))
    several = kept.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1")
    return kept.drop("nearest", "core").join(several, "region")


def _split(heavy: DataFrame, sets: DataFrame, limits: Threshold) -> tuple[DataFrame, DataFrame]:
    """One level of recursion: (links found, (region, doc, n) of the smaller regions)."""
    picks = heavy.groupBy("region").agg(F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("doc", F.lit(i)), F.col("doc"))).getField("doc") for i in range(PIVOTS)])).alias("pivots"))
    pairs = heavy.select("region", "doc").join(picks, "region").select("region", F.explode("pivots").alias("pivot"), "doc")
    measured = written(_distances(written(pairs, "region-pivots"), sets), "pivot-distances")
    links = measured.where(limits.linked(F.col("inter"), F.col("union")) & (F.col("pivot") != F.col("doc")))
    d = measured.withColumn("d", 1 - F.col("inter") / F.col("union"))
    home = d.groupBy("region", "doc").agg(F.min("d").alias("home"))
    placed = d.join(home, ["region", "doc"]).where(F.col("d") <= F.col("home") + 2 * limits.eps + 1e-9)
    return (links.select(F.col("pivot").alias("a"), F.col("doc").alias("b")),
            placed.select(F.xxhash64("region", "pivot").alias("region"), "doc", "n"))


def _join_leaves(members: DataFrame, sets: DataFrame, limits: Threshold) -> DataFrame:
    """Exact links (a, b) of rows (region, doc, weight); one task holds two chunks of bounded weight."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("weight") / F.lit(CHUNK_SHINGLES))).cast("int")
    dealt = members.withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    tiles = dealt.select("region", "doc", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.select("region", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                         "doc", "chunk").join(shuffled(sets), "doc")
    tiles = tiles.select(F.xxhash64("region", "i", "j").alias("tile"), (F.col("chunk") == F.col("i")).alias("left"),
                         (F.col("i") == F.col("j")).alias("alone"), "doc", "set")

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, alone, doc, sets_ in _groups(batches):
            a, b = _tile_links(left, bool(alone[0]), doc, [np.frombuffer(s, np.uint64) for s in sets_], limits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(join, "a long, b long"))


def _groups(batches: Iterator[pa.RecordBatch]):
    """Column lists of the rows of each value of the first column, from sorted batches."""
    key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        tile = ints(b.column(0))
        cuts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            cols = [b.column(i).slice(lo, hi - lo).to_pylist() for i in range(1, b.num_columns)]
            if key == tile[lo]:
                held = [x + y for x, y in zip(held, cols, strict=True)]
                continue
            if held is not None:
                yield held
            key, held = tile[lo], cols
    if held is not None:
        yield held


def _tile_links(left: list, alone: bool, doc: list, sets: list[np.ndarray], limits: Threshold):
    """A spanning set of the links among a tile's documents, by an inverted index."""
    doc, left = np.array(doc, np.int64), np.array(left, bool)
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    doc, left, n, sets = doc[order], left[order], n[order], [sets[i] for i in order]
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, ids = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(doc)), n)
    by = np.argsort(ids, kind="stable")
    posting = owner[by]
    first = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    at = np.concatenate(([0], np.cumsum(n)))
    root = np.arange(len(doc))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for x in range(len(doc)):
        if not alone and not left[x]:
            continue
        mine = ids[at[x]:at[x + 1]]
        lo, hi = first[mine], first[mine + 1]
        if not (hi - lo > 1).any():
            continue
        shared = np.bincount(np.concatenate([posting[i:j] for i, j in zip(lo, hi, strict=True)]), minlength=len(doc))
        hit = limits.linked(shared, n[x] + n - shared)
        hit[x] = False
        if not alone:
            hit &= ~left
        for y in np.flatnonzero(hit):
            rx, ry = find(x), find(int(y))
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                a.append(doc[x])
                b.append(doc[y])
    return np.array(a, np.int64), np.array(b, np.int64)


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85, chunk_shingles: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, group_rep (smallest doc_id with an identical set)."""
    limits = Threshold(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(_sketches(docs, width, limits), "sketches")
    heads = sketches.groupBy("set_key").agg(F.min("doc_id").alias("group_rep"))
    rows = written(sketches.select("doc_id", "n_shingles", "set_key").join(heads, "set_key").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("group_rep")).otherwise(
            F.col("doc_id")).alias("group_rep")), "representatives")
    copies = rows.where("doc_id <> group_rep").select(F.col("doc_id").alias("a"), F.col("group_rep").alias("b"))
    reps = rows.where("n_shingles > 0").select(F.col("group_rep").alias("doc")).distinct()

    # Copies would publish what their representative publishes, so only representatives do.
    near = written(_neighbourhoods(_publishers(sketches, rows, reps)), "neighbourhoods")
    discard(sketches)
    degree = near.groupBy("doc").agg(F.count(F.lit(1)).alias("degree"))
    best = near.join(shuffled(degree), "doc").groupBy("segment").agg(
        F.max(F.struct("degree", (-F.col("doc")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("members"))
    pivots = best.where("members > 1").select("segment", (-F.col("best.neg")).alias("pivot"))
    pairs = written(near.join(shuffled(pivots), "segment").select("pivot", "doc").distinct(), "pivot-pairs")

    sets = written(_with_sets(docs, pairs.select("doc").distinct(), width), "sets")
    measured = written(_distances(pairs.withColumn("region", F.col("pivot")).select("region", "pivot", "doc"), sets),
                       "distances")
    links = [copies, measured.where(limits.linked(F.col("inter"), F.col("union"))).select(
        F.col("pivot").alias("a"), F.col("doc").alias("b"))]

    limit = chunk_shingles or CHUNK_SHINGLES
    regions = written(_leftover(measured, limits), "leftover")
    for _ in range(MAX_LEVELS):
        heavy = regions.where(F.col("weight") > limit)
        if heavy.isEmpty():
            break
        found, parts = _split(heavy, sets, limits)
        links.append(found)
        size = parts.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
        parts = written(parts.join(size.where("members > 1"), "region"), "regions")
        before, after = (x.agg(F.sum("weight")).first()[0] or 0 for x in (heavy, parts))
        if after > before / 2:  # sum of weight over members ~ the work of joining: it no longer shrinks
            break
        regions = regions.where(F.col("weight") <= limit).select("region", "doc", "n", "members", "weight").unionByName(
            parts.select("region", "doc", "n", "members", "weight"))
    links.append(_join_leaves(regions.select("region", "doc", "weight"), sets, limits))

    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    found = components(edges)
    return rows.join(found, rows["doc_id"] == found["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "group_rep")


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; documents without a set all stay."""
    kept = ngram_components(docs, **options).where("component_id <=> doc_id").select(
        F.col("doc_id").alias("__keep")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__keep"]), "left_semi")
