"""Boosted trees with L1/L2 leaf penalties, binary and softmax.

Every round grows one tree (one for each class), level by level.  A level is one Spark job: tasks bin the
gradients and hessians of their rows by (class, node, feature, bin), Spark sums them, and the driver, which
only ever sees these sums (bounded by classes x nodes x features x bins, whatever the rows), picks the
split of each node.  The gain of a split is T(GL)^2/(HL+l2) + T(GR)^2/(HR+l2) - T(G)^2/(H+l2) with
T(G) = sign(G) max(|G| - l1, 0), and a leaf's value is -step T(G)/(H+l2).  A child's sums are known when its
parent splits, so a tree of depth d takes d jobs; of two siblings only the lighter one is summed from rows, the other has what
is left of their parent.

The rows are binned once (exact quantile cuts, at most ``bins`` bins) and kept as a written table of blocks in the
shared checkpoint folder, with the margins of the rounds finished so far; every ``REBASE`` rounds a new table is
written and the one before it dropped.  A round reads that table, applies the few trees since and keeps the drawn rows' bins,
gradients and hessians for its levels (in memory, else on disk), so nothing has a long lineage and a lost executor only
repeats its tasks.  Features whose bins come together in at most 256 ways in all rows share one byte (``_Packing``): rows are
binned by these bytes, and the driver adds the places of a byte up to the bins of its features.
At most ``GATHERED_ROWS`` rows (some 40 MB) are gone through by the driver itself, as a job for each level would take
longer than all else; sums of a few partitions are added up by the driver while they are ``GATHERED_SUMS`` places at most.

The model does not depend on the number of cores or the order of rows: gradients are summed as fixed-point
integers, rows are sampled by a hash of their id columns and the round, features by the round and class, and
ties between splits go to the first feature and bin.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.quantiles import cut_points
from riskloom.session import drop_scratch, scratch_path

REBASE = 10
PARTITION_ROWS = 32_768
GATHERED_SUMS = 1 << 20         # places of all partitions together (32 bytes each) that the driver adds up itself
GATHERED_ROWS = 1 << 20         # packed rows (a byte a column and 28 with one class) that the driver keeps
_UNIT = float(1 << 24)          # gradients are summed in steps of 1 / _UNIT
_LEAST_GAIN = 1e-6
_GUESS_ROWS = 4096              # rows by which features are guessed to share a byte; all rows prove it
_BLOCK = "n int, x binary, y binary, w binary, k binary, m binary"
_DRAWN = "n int, x binary, g binary, h binary"
_HISTOGRAM = "cls int, slot int, feature int, bin int, g long, h long"


@dataclass(frozen=True)
class Boosting:
    """Fit parameters; ``l1`` and ``l2`` penalise leaf values, ``least_child`` is the least hessian of a child."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 5
    rows: float = 1.0
    features: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    least_child: float = 1.0
    bins: int = 256


def _levels(tree: dict) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """Of each level the (place, node) of its inner nodes, and the node of each place below the last level.

    A row's place is 0 at the root, then twice its place of the level before, and one more if it went right; below a
    leaf it goes on to the left.
    """
    levels, at = [], {0: 0}
    while any(tree["left"][node] >= 0 for node in at.values()):
        levels.append([(place, node) for place, node in at.items() if tree["left"][node] >= 0])
        inner = dict(levels[-1])
        at = {2 * place + i: node if place not in inner else int(tree["right" if i else "left"][node])
              for place, node in at.items() for i in range(2 if place in inner else 1)}
    nodes = np.zeros(1 << len(levels), np.int64)
    nodes[list(at)] = list(at.values())
    return levels, nodes


def _places(n: int, levels: list[list[tuple[int, object]]], right: Callable) -> np.ndarray:
    """Place of each of ``n`` rows below the last level; ``right`` gives the rows that go right at a split."""
    place = np.zeros(n, np.min_scalar_type((1 << len(levels)) - 1))
    for i, level in enumerate(levels):
        went = np.zeros(n, bool)
        for at, split in level:
            went |= right(split) & (place == at) if i else right(split)
        place <<= 1
        place |= went
    return place


class Margins:
    """Margins of raw feature values: these are numbered by the model's thresholds once, all trees compare the numbers."""

    def __init__(self, rounds: list[list[dict]], classes: int):
        self.classes, trees = classes, [t for trees in rounds for t in trees]
        inner = [t["left"] >= 0 for t in trees]
        features = np.concatenate([t["feature"][i] for t, i in zip(trees, inner, strict=True)]) if trees else np.zeros(0, np.int64)
        cuts = np.concatenate([t["threshold"][i] for t, i in zip(trees, inner, strict=True)]) if trees else np.zeros(0)
        self.cuts = {int(f): np.unique(cuts[features == f]) for f in np.unique(features)}
        self.kind = np.min_scalar_type(max((len(c) for c in self.cuts.values()), default=0))
        self.trees = []
        for c, t in ((c, t) for trees in rounds for c, t in enumerate(trees)):
            levels, nodes = _levels(t)
            cut = {node: int(np.searchsorted(self.cuts[int(t["feature"][node])], t["threshold"][node])) for level in levels for _, node in level}
            self.trees.append((c, [[(at, (int(t["feature"][node]), cut[node])) for at, node in level] for level in levels], t["value"][nodes]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes)."""
        out = np.zeros((self.classes, len(x)))
        number = {f: np.searchsorted(cuts, x[:, f], "left").astype(self.kind) for f, cuts in self.cuts.items()}
        for c, levels, values in self.trees:
            out[c] += values[_places(len(x), levels, lambda split: number[split[0]] > split[1])]
        return out.T


def margins(x: np.ndarray, rounds: list[list[dict]], classes: int) -> np.ndarray:
    """(rows, classes) margins of raw feature values."""
    return Margins(rounds, classes)(x)


def probabilities(m: np.ndarray) -> np.ndarray:
    """Of the classes; a single margin column is the log odds of class 1 against class 0."""
    if m.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-m[:, 0]))
        return np.stack((1.0 - p, p), 1)
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _gradients(m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point gradients and hessians, (rows, classes)."""
    p = probabilities(m)
    if m.shape[1] == 1:
        p = p[:, 1:]
        g, h = p - (y == 1)[:, None], np.maximum(p * (1 - p), 1e-16)
    else:
        g, h = p - (y[:, None] == np.arange(m.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)
    return np.rint(g * w[:, None] * _UNIT), np.rint(h * w[:, None] * _UNIT)


def _mixed(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Uniform numbers in [0, 1) by row key, seed and round."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


class _Packing:
    """Binned features as few columns of bytes.

    The features of a column (``members``) have at most 256 combinations of bins in all rows, numbered in ascending order of
    ``keys`` (the bins as digits of one number); a feature alone in its column keeps its bins.
    """

    def __init__(self, widths: np.ndarray, members: list[list[int]], keys: list[np.ndarray]):
        self.widths, self.members, self.keys = widths, members, keys
        self.column = np.zeros(len(widths), np.int64)
        self.bins: dict[int, np.ndarray] = {}                    # of a feature: its bin by the number in its column
        for c, (features, found) in enumerate(zip(members, keys, strict=True)):
            for f, unit in zip(features, self.units(features), strict=True):
                self.column[f], self.bins[f] = c, (found // unit) % widths[f]
        self.sizes = np.array([len(k) for k in keys])
        self.order = {f: np.argsort(b, kind="stable") for f, b in self.bins.items()}

    def units(self, features: list[int]) -> np.ndarray:
        return np.cumprod([1, *self.widths[features[:-1]]], dtype=np.int64)

    def mixed(self, binned: np.ndarray, features: list[int]) -> np.ndarray:
        return self.units(features) @ binned[features].astype(np.int64)

    def packed(self, binned: np.ndarray) -> np.ndarray:
        """(columns, rows) bytes of (features, rows) bins."""
        return np.stack([binned[m[0]] if len(m) == 1 else np.searchsorted(k, self.mixed(binned, m)).astype(np.uint8)
                         for m, k in zip(self.members, self.keys, strict=True)])

    def compiled(self, tree: dict) -> tuple[list, np.ndarray]:
        """The levels of a tree with (column, for each byte whether it goes right), and its node by place."""
        levels, nodes = _levels(tree)

        def split(node: int) -> tuple[int, bytes]:
            f = int(tree["feature"][node])
            goes = np.zeros(256, np.uint8)
            goes[:len(self.bins[f])] = self.bins[f] > tree["bin"][node]
            return int(self.column[f]), goes.tobytes()
        return [[(at, split(node)) for at, node in level] for level in levels], nodes

    @classmethod
    def alone(cls, widths: np.ndarray) -> "_Packing":
        return cls(widths, [[f] for f in range(len(widths))], [np.arange(w) for w in widths])

    def guessed(self, binned: np.ndarray) -> list[list[int]]:
        """Features to be put together, by some rows: each joins the column whose combinations it adds least to."""
        held: list[tuple[list[int], np.ndarray, int]] = []
        size = np.array([len(np.unique(v)) for v in binned])
        for f in np.argsort(-size, kind="stable").tolist():
            best = None
            for i, (features, number, count) in enumerate(held):
                if float(np.prod(self.widths[[*features, f]].astype(float))) >= 2.0 ** 62:
                    continue
                found, joint = np.unique(number * 256 + binned[f], return_inverse=True)
                if len(found) <= 256 and (best is None or len(found) / count < best[0]):
                    best = (len(found) / count, i, joint, len(found))
            if best is None:
                held.append(([f], np.unique(binned[f], return_inverse=True)[1].astype(np.int64), max(1, int(size[f]))))
            else:
                held[best[1]] = ([*held[best[1]][0], f], best[2].astype(np.int64), best[3])
        return [sorted(features) for features, _, _ in held]

    @classmethod
    def of(cls, rows: DataFrame, cuts: list[np.ndarray]) -> "_Packing":
        """Columns guessed by a few rows and proved by all: one with more combinations is halved and proved again."""
        widths = np.array([len(c) + 1 for c in cuts])
        alone = cls.alone(widths)
        few = rows.select("x").limit(_GUESS_ROWS).toArrow().column(0).combine_chunks()
        open_ = alone.guessed(_binned(few, cuts)) if len(few) else []
        members, keys = [m for m in open_ if len(m) == 1], []
        open_ = [m for m in open_ if len(m) > 1]
        keys = [np.arange(widths[m[0]]) for m in members]
        while open_:
            def seen(batches: Iterator[pa.RecordBatch], tried=tuple(open_)) -> Iterator[pa.RecordBatch]:
                found: list[np.ndarray | None] = [np.zeros(0, np.int64) for _ in tried]
                for b in batches:
                    if b.num_rows:
                        binned = _binned(b.column(0), cuts)
                        for i, m in enumerate(tried):
                            if found[i] is not None:
                                both = np.union1d(found[i], alone.mixed(binned, m))
                                found[i] = both if len(both) <= 256 else None
                for i, v in enumerate(found):                        # -1: too many
                    v = np.array([-1]) if v is None else v
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.astype(np.int64))], names=["i", "key"])
            table = rows.select("x").mapInArrow(seen, "i int, key long").distinct().toArrow()   # 256 a partition and column
            i, key = (table.column(c).to_numpy() for c in range(2))
            again = []
            for j, m in enumerate(open_):
                found = np.sort(key[i == j])
                if len(found) and found[0] >= 0 and len(found) <= 256:
                    members, keys = [*members, m], [*keys, found]
                else:
                    again += [m[:len(m) // 2], m[len(m) // 2:]]
            members, keys = members + [m for m in again if len(m) == 1], keys + [np.arange(widths[m[0]]) for m in again if len(m) == 1]
            open_ = [m for m in again if len(m) > 1]
        return cls(widths, members, keys) if members else alone


def _binned(x: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows) bins of lists of values."""
    v = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(cuts))
    return np.stack([np.searchsorted(c, v[:, f], "left").astype(np.uint8) for f, c in enumerate(cuts)])


class _Rows:
    """Packed columns (columns, rows), and which rows go right at a split."""

    def __init__(self, x: np.ndarray):
        self.x, self.bytes = x, {}

    def right(self, split: tuple[int, bytes]) -> np.ndarray:
        column, goes = split
        if column not in self.bytes:
            self.bytes[column] = self.x[column].tobytes()
        return np.frombuffer(self.bytes[column].translate(goes), bool)

    def places(self, levels: list) -> np.ndarray:
        return _places(self.x.shape[1], levels, self.right)


@dataclass
class _Block:
    """Packed rows (``x``: columns, rows) with their margins."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    k: np.ndarray
    m: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, classes: int) -> "_Block":
        n = batch.column(0)[i].as_py()
        x, y, w, k, m = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in
                         enumerate((np.uint8, np.int32, np.float64, np.uint64, np.float64), 1))
        return cls(x.reshape(-1, n), y, w, k, m.reshape(n, classes).copy())

    def advance(self, rounds: list[list[tuple]]) -> "_Block":
        """Margins after ``rounds`` more of (levels, values by place) of each class."""
        rows = _Rows(self.x)
        for trees in rounds:
            for c, (levels, values) in enumerate(trees):
                self.m[:, c] += values[rows.places(levels)]
        return self

    def drawn(self, seed: int, turn: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that a round draws: their packed columns and their gradients and hessians (classes, rows)."""
        at = np.flatnonzero(_mixed(self.k, seed, turn) < share)
        if len(at) == len(self.y):
            return self.x, *(np.ascontiguousarray(v.T) for v in _gradients(self.m, self.y, self.w))
        return np.take(self.x, at, 1), *(np.ascontiguousarray(v.T) for v in _gradients(self.m[at], self.y[at], self.w[at]))

    def record(self) -> list:
        return [len(self.y), *(a.tobytes() for a in (self.x, self.y, self.w, self.k, self.m))]


def _steps(rounds: list[list[dict]], packing: _Packing) -> list[list[tuple]]:
    """Rounds of trees as ``_Block.advance`` takes them."""
    return [[(levels, t["value"][nodes]) for t in trees for levels, nodes in [packing.compiled(t)]] for trees in rounds]


def _blocks_out(blocks: list[_Block]) -> pa.RecordBatch:
    columns = list(zip(*(b.record() for b in blocks), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                      names=["n", "x", "y", "w", "k", "m"])


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, os.path.join("boosting", f"{name}-{uuid.uuid4().hex}"))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def feature_cuts(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Ascending cut values of each feature: bin b holds values above cut b - 1, up to cut b."""
    values = rows.select(F.posexplode("x").alias("feature", "value"))
    found: list[list[float]] = [[] for _ in range(d)]
    for r in cut_points(values, "value", "feature", bins - 1).collect():       # at most bins - 1 a feature
        found[r["feature"]].append(r["value"])
    return [np.array(sorted(v)) for v in found]


def _to_blocks(rows: DataFrame, cuts: list[np.ndarray], packing: _Packing, classes: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, w, k = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            yield _blocks_out([_Block(packing.packed(_binned(b.column(0), cuts)), y.astype(np.int32), w.astype(np.float64), k.view(np.uint64),
                                      np.zeros((b.num_rows, classes)))])
    return rows.select("x", "y", "w", "k").mapInArrow(pack, _BLOCK)


def _drawn(blocks: DataFrame, since: list[list[dict]], packing: _Packing, classes: int, seed: int, turn: int, share: float) -> DataFrame:
    """The rows that a round draws, see ``_Block.drawn``."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(since, packing)
        for batch in batches:
            for i in range(batch.num_rows):
                x, g, h = _Block.of(batch, i, classes).advance(steps).drawn(seed, turn, share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.shape[1]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, g, h))],
                    names=["n", "x", "g", "h"])

    return blocks.mapInArrow(draw, _DRAWN)


def _counted(drawn: Iterable[tuple], growing: list[dict], asked: list[np.ndarray], columns: list[np.ndarray],
             packing: _Packing) -> pa.RecordBatch:
    """Sums over some blocks of drawn rows, of the places that have any."""
    slots, sizes = [int(a.max()) + 1 for a in asked], packing.sizes
    total = [[np.zeros((2, s * sizes[f])) for f in own] if s else [] for s, own in zip(slots, columns, strict=True)]
    trees = [packing.compiled(t) if s else None for t, s in zip(growing, slots, strict=True)]
    for x, g, h in drawn:
        rows = _Rows(x)
        for c in np.flatnonzero(slots):
            levels, nodes = trees[c]
            values, slot, held = (g[c], h[c]), None, x
            if levels:
                slot = asked[c][nodes][rows.places(levels)]
                at = np.flatnonzero(slot >= 0)
                slot, held, values = slot[at], np.take(x[columns[c]], at, 1), tuple(v[at] for v in values)
            for j, (f, sums) in enumerate(zip(columns[c], total[c], strict=True)):
                place = held[f] if slot is None else slot * sizes[f] + held[j]
                for into, v in zip(sums, values, strict=True):
                    into += np.bincount(place, v, len(into))
    found = [(c, f, sums.astype(np.int64)) for c, own in enumerate(columns) for f, sums in zip(own, total[c])]
    found = [(c, f, np.flatnonzero(sums.any(0)), sums) for c, f, sums in found]
    size = [len(seen) for _, _, seen, _ in found]
    cls, feature = (np.repeat(np.array([v[i] for v in found], np.int32), size) for i in (0, 1))
    slot, b = np.divmod(np.concatenate([seen for _, _, seen, _ in found] or [np.zeros(0, np.int64)]), sizes[feature])
    both = np.concatenate([sums[:, seen] for _, _, seen, sums in found] or [np.zeros((2, 0), np.int64)], 1)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(v.astype(np.int32)) for v in (cls, slot, feature, b)), *(pa.array(v) for v in both)],
        names=["cls", "slot", "feature", "bin", "g", "h"])


def _level_sums(drawn: DataFrame | list[tuple], growing: list[dict], asked: list[np.ndarray], columns: list[np.ndarray],
                packing: _Packing, partitions: int) -> pa.Table:
    """Sums of gradients and hessians by (class, slot of the node, packed column, byte), one row each, of the nodes with a
    slot in ``asked``, of the rows' ``partitions``."""
    if isinstance(drawn, list):
        return pa.Table.from_batches([_counted(drawn, growing, asked, columns, packing)])
    classes = len(growing)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for i in range(batch.num_rows):
                    n = batch.column(0)[i].as_py()
                    x, g, h = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in enumerate((np.uint8, np.float64, np.float64), 1))
                    yield x.reshape(-1, n), g.reshape(classes, n), h.reshape(classes, n)
        yield _counted(blocks(), growing, asked, columns, packing)

    sums = drawn.mapInArrow(count, _HISTOGRAM)
    if partitions == 1:
        return sums.toArrow()
    # A few small tables are added up at once: a shuffle for them would take longer than all else of a level.
    places = sum((int(a.max()) + 1) * int(packing.sizes[f].sum()) for a, f in zip(asked, columns, strict=True))
    if partitions * places <= GATHERED_SUMS:
        return sums.toArrow().group_by(["cls", "slot", "feature", "bin"]).aggregate([("g", "sum"), ("h", "sum")]).rename_columns(
            ["cls", "slot", "feature", "bin", "g", "h"])
    # A task has each place once, so nothing is gained by adding up before the shuffle.
    parts = min(drawn.sparkSession.sparkContext.defaultParallelism, int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sums.repartition(parts, "feature", "bin").groupBy("cls", "slot", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()


def _softened(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


class _Growing:
    """A tree as lists of nodes, and the nodes of its last level that may split, siblings side by side.

    The places of a node's sums are the bins of the ``columns``, one column after the other.
    """

    def __init__(self, columns: np.ndarray, packing: _Packing):
        widths = packing.widths
        self.nodes = {k: [] for k in ("feature", "bin", "left", "right", "value", "cover", "gain")}
        self.open = [self.add(0.0, 0.0)]
        self.asked = self.open                  # nodes to be summed from rows
        self.parents = None                     # sums of the parents of the open nodes, one for each pair
        self.columns, self.ends = columns, np.cumsum(widths[columns])
        self.starts = self.ends - widths[columns]
        # Bytes of the packed columns side by side, put in order of each feature's bins, and where a bin begins in that order.
        self.packed = np.unique(packing.column[columns])
        self.offset = np.zeros(len(packing.sizes), np.int64)
        self.offset[self.packed] = np.cumsum(packing.sizes[self.packed]) - packing.sizes[self.packed]
        self.bytes = int(packing.sizes[self.packed].sum())
        self.order = np.concatenate([self.offset[packing.column[f]] + packing.order[f] for f in columns])
        place = np.concatenate([s + packing.bins[f][packing.order[f]] for f, s in zip(columns, self.starts, strict=True)])
        self.begins = np.flatnonzero(np.diff(place, prepend=-1))
        self.held = place[self.begins]

    def add(self, value: float, cover: float) -> int:
        for k, v in zip(self.nodes, (0, 0, -1, -1, value, cover, 0.0), strict=True):
            self.nodes[k].append(v)
        return len(self.nodes["left"]) - 1

    def arrays(self) -> dict:
        kinds = {k: np.float64 if k in ("value", "cover", "gain") else np.int64 for k in self.nodes}
        return {k: np.array(v, kinds[k]) for k, v in self.nodes.items()}

    def slots(self) -> np.ndarray:
        out = np.full(len(self.nodes["left"]), -1, np.int64)
        out[self.asked] = np.arange(len(self.asked))
        return out

    def sums(self, cls: int, table: pa.Table) -> np.ndarray:
        """(open nodes, places, 2): integer sums from the ``table`` of the asked nodes."""
        t = table.filter(pa.compute.equal(table["cls"], cls))
        raw = np.zeros((len(self.asked), self.bytes, 2), np.int64)
        raw[t["slot"].to_numpy(), self.offset[t["feature"].to_numpy()] + t["bin"].to_numpy()] = np.stack((t["g"].to_numpy(), t["h"].to_numpy()), 1)
        known = np.zeros((len(self.asked), self.ends[-1], 2), np.int64)
        known[:, self.held] = np.add.reduceat(raw[:, self.order], self.begins, 1)
        if self.parents is None:
            return known
        out = np.empty((len(self.open), *known.shape[1:]), np.int64)
        first = np.array(self.asked) == np.array(self.open[::2])
        out[0::2] = np.where(first[:, None, None], known, self.parents - known)
        out[1::2] = self.parents - out[0::2]
        return out

    def split(self, sums: np.ndarray, p: Boosting) -> None:
        """Splits the open nodes by their ``sums``; their children are open next."""
        upto = np.cumsum(sums, 1)
        whole = upto[:, self.ends[0] - 1] / _UNIT
        before = np.concatenate((np.zeros((len(sums), 1, 2), np.int64), upto[:, self.ends[:-1] - 1]), 1)
        left = (upto - np.repeat(before, self.ends - self.starts, 1)) / _UNIT
        right = whole[:, None] - left
        (gl, hl), (gr, hr) = (np.moveaxis(v, 2, 0) for v in (left, right))
        gain = (_softened(gl, p.l1) ** 2 / (hl + p.l2) + _softened(gr, p.l1) ** 2 / (hr + p.l2)
                - (_softened(whole[:, 0], p.l1) ** 2 / (whole[:, 1] + p.l2))[:, None])
        gain[(hl < p.least_child) | (hr < p.least_child)] = -np.inf
        best = np.argmax(gain, 1)
        if self.parents is None:
            self.nodes["value"][0] = -p.step * float(_softened(whole[0, 0], p.l1) / (whole[0, 1] + p.l2))
            self.nodes["cover"][0] = float(whole[0, 1])
        again, parents, asked = [], [], []
        for i, (node, b) in enumerate(zip(self.open, best, strict=True)):
            if not gain[i, b] > _LEAST_GAIN:
                continue
            f = int(np.searchsorted(self.ends, b, "right"))
            children = [self.add(-p.step * float(_softened(g, p.l1) / (h + p.l2)), float(h))
                        for g, h in ((gl[i, b], hl[i, b]), (gr[i, b], hr[i, b]))]
            for k, v in zip(("feature", "bin", "left", "right", "gain"),
                            (int(self.columns[f]), int(b - self.starts[f]), *children, float(gain[i, b])), strict=True):
                self.nodes[k][node] = v
            again += children
            parents.append(i)
            asked.append(children[0] if hl[i, b] <= hr[i, b] else children[1])
        self.open, self.asked, self.parents = again, asked, sums[parents]


@dataclass
class BoostedTrees:
    """Fitted rounds of trees; a tree is a dict of node arrays (feature, threshold, bin, left, right, value, cover, gain)."""

    rounds: list[list[dict]]
    classes: int                # margins: 1 for two classes
    width: int                  # features

    @property
    def featureImportances(self) -> DenseVector:                                                        # M15
        """Mean gain of the splits on each feature, scaled to sum to 1."""
        gain, n = np.zeros(self.width), np.zeros(self.width)
        for trees in self.rounds:
            for t in trees:
                inner = t["left"] >= 0
                np.add.at(gain, t["feature"][inner], t["gain"][inner])
                np.add.at(n, t["feature"][inner], 1)
        mean = np.divide(gain, n, out=np.zeros(self.width), where=n > 0)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:                        # M24
        """``df`` with rawPrediction and probability (vectors) and prediction (double; ties to the smaller class)."""
        sent = df.sparkSession.sparkContext.broadcast((self.rounds, self.classes))

        @F.pandas_udf("array<double>")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            of = Margins(*sent.value)
            for x in batches:
                yield pd.Series(list(of(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

        @F.pandas_udf("array<double>")
        def probable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for m in batches:
                yield pd.Series(list(probabilities(np.stack(m.to_numpy()))) if len(m) else [], dtype=object)

        m = margin(vector_to_array(features))
        out = df.withColumn("_m", m).withColumn("_p", probable("_m"))
        raw = F.array(-F.col("_m")[0], F.col("_m")[0]) if self.classes == 1 else F.col("_m")
        return out.withColumns({
            "rawPrediction": array_to_vector(raw), "probability": array_to_vector("_p"),
            "prediction": (F.array_position("_p", F.array_max("_p")) - 1).cast("double")}).drop("_m", "_p")

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet and the sizes as one JSON line; bounded by the model."""
        names = ["feature", "threshold", "bin", "left", "right", "value", "cover", "gain"]
        rows = [(r, c, i, *(t[k][i].item() for k in names)) for r, trees in enumerate(self.rounds) for c, t in enumerate(trees)
                for i in range(len(t["left"]))]
        spark.createDataFrame(rows, "round int, cls int, node int, feature int, threshold double, bin int, left int, right int, "
                              "value double, cover double, gain double").write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        meta = json.dumps({"classes": self.classes, "width": self.width, "rounds": len(self.rounds)})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()["value"])
        nodes = spark.read.parquet(os.path.join(path, "nodes")).toPandas().sort_values(["round", "cls", "node"])
        rounds: list[list[dict]] = [[] for _ in range(meta["rounds"])]
        for (r, _), t in nodes.groupby(["round", "cls"], sort=True):
            rounds[r].append({k: t[k].to_numpy(np.float64 if k in ("threshold", "value", "cover", "gain") else np.int64)
                              for k in nodes.columns[3:]})
        return cls(rounds, meta["classes"], meta["width"])


def fit(df: DataFrame, label: str, id_cols: list[str], params: Boosting, classes: int = 2, features: str = "features",
        weight: str | None = None, seed: int = 42) -> BoostedTrees:
    """Fit on the vector column ``features`` and the class codes 0 .. classes - 1 in ``label``.

    Rows that agree in ``id_cols`` are sampled together.  Without any row the model has no trees.
    """
    key = F.xxhash64(*[F.col(c).cast("string") for c in id_cols])
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), key.alias("k"))
    first = rows.first()
    if first is None:
        return BoostedTrees([], 1 if classes == 2 else classes, 0)
    d, columns = len(first["x"]), 1 if classes == 2 else classes
    if not 2 <= params.bins <= 256:
        raise ValueError("bins must be 2 to 256")
    cuts = feature_cuts(rows, d, params.bins)
    packing, n = _Packing.of(rows, cuts), rows.count()
    # Few rows in many partitions would make every level a job of many tasks with next to nothing to do.
    blocks = _to_blocks(rows.coalesce(-(-n // PARTITION_ROWS)), cuts, packing, columns)
    few = _gathered(blocks, columns) if n * columns <= min(GATHERED_ROWS, GATHERED_SUMS) else None
    if few is None:
        blocks, path = _written(blocks, "blocks")
    done: list[list[dict]] = []
    since: list[list[dict]] = []
    for turn in range(params.rounds):
        chosen = [np.sort(np.random.default_rng([seed, turn, c]).choice(d, max(1, int(params.features * d)), replace=False))
                  for c in range(columns)]
        trees = [_Growing(c, packing) for c in chosen]
        if few is not None:
            last = _steps(done[-1:], packing)
            partitions, drawn = 1, [b.advance(last).drawn(seed, turn, params.rows) for b in few]
        else:
            if not since:
                partitions = blocks.rdd.getNumPartitions()
            drawn = _drawn(blocks, since, packing, columns, seed, turn, params.rows).persist(StorageLevel.MEMORY_AND_DISK)
        for _ in range(params.depth):
            if not any(t.open for t in trees):
                break
            table = _level_sums(drawn, [t.arrays() for t in trees], [t.slots() for t in trees], [t.packed for t in trees], packing, partitions)
            for c, t in enumerate(trees):
                if t.open:
                    t.split(t.sums(c, table), params)
        if few is not None:
            done.append([t.arrays() for t in trees])
            continue
        drawn.unpersist()
        since.append([t.arrays() for t in trees])
        if len(since) == REBASE and turn + 1 < params.rounds:
            before, (blocks, path) = path, _written(_advanced(blocks, since, packing, columns), "blocks")
            drop_scratch(df.sparkSession, before)
            done, since = done + since, []
    if few is None:
        drop_scratch(df.sparkSession, path)
    for trees in (done := done + since):
        for t in trees:
            t["threshold"] = np.array([cuts[f][b] if left >= 0 else 0.0 for f, b, left in
                                       zip(t["feature"], t["bin"], t["left"], strict=True)])
    return BoostedTrees(done, columns, d)


def _gathered(blocks: DataFrame, classes: int) -> list[_Block]:
    """All rows, ``GATHERED_ROWS`` at most, in blocks that fit a cache."""
    parts = [_Block.of(b, i, classes) for b in blocks.toArrow().to_batches() for i in range(b.num_rows)]
    ends = np.cumsum([len(p.y) for p in parts])
    held = [[p for p, e in zip(parts, ends, strict=True) if (e - 1) // PARTITION_ROWS == i] for i in range(-(-int(ends[-1]) // PARTITION_ROWS))]
    return [_Block(*(np.concatenate([getattr(p, v) for p in same], axis) for v, axis in zip("xywkm", (1, 0, 0, 0, 0), strict=True)))
            for same in held if same]


def _advanced(blocks: DataFrame, since: list[list[dict]], packing: _Packing, classes: int) -> DataFrame:
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(since, packing)
        for batch in batches:
            if batch.num_rows:
                yield _blocks_out([_Block.of(batch, i, classes).advance(steps) for i in range(batch.num_rows)])
    return blocks.mapInArrow(move, _BLOCK)
