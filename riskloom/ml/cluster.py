"""Clustering: scaled vectors, k-means with restarts, k sweep, PCA, profiles.

Every fit and every silhouette is distributed (no sampling, no collect of rows).  The vectors are written once as a
table of packed blocks in the shared checkpoint folder.  The restarts of a fit go side by side: an iteration is one job that reads
the blocks once for all restarts still moving, and only sums by cluster reach the driver.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.ml.encode import PopulationScaler, fit_apply_codes
from riskloom.session import at_once, drop_scratch, scratch_path

NUM_COLS = ["host_count", "hour", "dow", "month"]
CAT_COLS = ["enterprise_type", "region", "season", "region_industry", "industry_threat"]
CLUSTER_FEATURES = NUM_COLS + [f"{c}_enc" for c in CAT_COLS]
DEFAULT_SEEDS = tuple(range(42, 52))       # ten restarts
SWEEP_FITS = 9                             # values of k fitted side by side
CHUNK = 4096                               # rows whose scores are held at once
INIT_STEPS = 2
LOCAL_ITER = 30


def encode_for_clustering(df: DataFrame):
    """Label codes of the five categorical columns (M01) → (frame, vocabularies)."""
    return fit_apply_codes(df, CAT_COLS)


def scaled_vectors(df: DataFrame, scaler: PopulationScaler, cols=CLUSTER_FEATURES,
                   out: str = "features") -> DataFrame:                   # M03 + M04
    z = df.withColumns({f"_z_{c}": scaler.column(c) for c in cols})
    vec = VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol=out).transform(z)
    return vec.drop(*[f"_z_{c}" for c in cols])


def packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``features`` as a written table of blocks (dimensions, rows), and its path."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["n", "x"])

    spark = vectors.sparkSession
    path = scratch_path(spark, os.path.join("clustering", f"vectors-{uuid.uuid4().hex}"))
    blocks = vectors.select(vector_to_array("features").alias("x")).mapInArrow(pack, "n int, x binary")
    blocks.write.option("compression", "none").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path), path


def _added(blocks: DataFrame, sums: Callable[[np.ndarray, int], list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays that ``sums`` gives for each block (dimensions, rows) and its hash, added up over all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, key in _blocks_in(batches):
            found = sums(x, key)
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[v.astype(np.float64).tobytes() for v in total]], pa.list_(pa.binary()))], names=["sums"])

    parts = blocks.mapInArrow(run, "sums array<binary>").toArrow().column(0).to_pylist()      # one row a partition
    return [sum(np.frombuffer(v) for v in same) for same in zip(*parts, strict=True)]


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            yield np.frombuffer(raw).reshape(-1, n), zlib.crc32(raw)


def _chunks(x: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of the rows, with a last dimension of ones."""
    for i in range(0, x.shape[1], CHUNK):
        part = x[:, i:i + CHUNK]
        yield np.concatenate((part, np.ones((1, part.shape[1]))))


def _planes(centres: list[np.ndarray]) -> np.ndarray:
    """(k, restarts, dimensions + 1): the j-th centre of each restart and minus half its square; missing ones never win."""
    k, d = max(len(c) for c in centres), centres[0].shape[1]
    out = np.zeros((k, len(centres), d + 1))
    out[..., d] = -np.inf
    for i, c in enumerate(centres):
        out[:len(c), i, :d], out[:len(c), i, d] = c, -0.5 * (c * c).sum(1)
    return out


def _nearest(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each restart and row, the nearest centre (the first of equals) and its score, (square of the row - square of the distance) / 2."""
    best = planes[0] @ x
    label, score = np.zeros(best.shape, np.min_scalar_type(len(planes) - 1)), np.empty_like(best)
    more, own = np.empty(best.shape, bool), np.empty_like(label)
    for j in range(1, len(planes)):
        np.matmul(planes[j], x, out=score)
        np.multiply(np.greater(score, best, out=more), label.dtype.type(j), out=own)
        np.maximum(label, own, out=label)
        np.maximum(best, score, out=best)
    return label, best


def _cluster_sums(planes: np.ndarray) -> Callable:
    """For ``_added``: by (restart, centre) the sums of the dimensions, the rows and the sum of their squares; and the restarts' costs."""
    k, m, d = planes.shape[0], planes.shape[1], planes.shape[2] - 1

    def sums(x: np.ndarray, _: int) -> list[np.ndarray]:
        total, cost, centre = np.zeros((m, k, d + 2)), np.zeros(m), np.arange(k)[:, None]
        for part in _chunks(x):
            label, best = _nearest(part, planes)
            square = (part[:d] ** 2).sum(0)
            held = np.concatenate((part, square[None])).T
            for i in range(m):
                total[i] += (label[i] == centre).astype(np.float64) @ held
            cost += square.sum() - 2 * best.sum(1)
        return [total.ravel(), cost]
    return sums


class FittedKMeans(KMeansModel):
    """Spark's model of given centres, with the cost and iterations of the fit as its summary."""

    @classmethod
    def of(cls, spark: SparkSession, centres: np.ndarray, cost: float, iterations: int) -> "FittedKMeans":
        jvm = spark.sparkContext._jvm
        inner = jvm.org.apache.spark.mllib.clustering.KMeansModel(_py2java(spark.sparkContext, [Vectors.dense(c) for c in centres]))
        out = cls(jvm.org.apache.spark.ml.clustering.KMeansModel(f"kmeans_{uuid.uuid4().hex[:12]}", inner))
        out.centres, out._summary = centres, SimpleNamespace(trainingCost=cost, numIter=iterations, k=len(centres))
        return out._set(k=max(2, len(centres)))

    @property
    def summary(self):
        return self._summary


@dataclass
class KMeans:
    """Restarts of Lloyd's iterations side by side, each from its own k-means|| centres; the least cost wins, the first on ties.

    A restart ends when no centre moves by more than ``tol``; a centre without rows stays where it is.  Its cost is that of its
    last iteration, before the centres move.
    """

    k: int
    seeds: tuple = DEFAULT_SEEDS
    max_iter: int = 300
    tol: float = 1e-4

    def fit(self, blocks: DataFrame) -> FittedKMeans:
        """Fit on a table of :func:`packed`."""
        centres = self.first_centres(blocks)
        moving, cost, taken = list(range(len(centres))), np.full(len(centres), np.inf), np.zeros(len(centres), int)
        for _ in range(self.max_iter):
            planes = _planes([centres[i] for i in moving])
            k, m, d = planes.shape[0], planes.shape[1], planes.shape[2] - 1
            total, found = _added(blocks, _cluster_sums(planes))
            total = total.reshape(m, k, d + 2)
            still = []
            for j, i in enumerate(moving):
                cost[i], taken[i], own = max(0.0, found[j]), taken[i] + 1, len(centres[i])
                rows = total[j, :own, d:d + 1]
                moved = np.where(rows > 0, total[j, :own, :d] / np.maximum(rows, 1), centres[i])
                if ((moved - centres[i]) ** 2).sum(1).max() > self.tol ** 2:
                    still.append(i)
                centres[i] = moved
            moving = still
            if not moving:
                break
        best = int(np.argmin(cost))
        return FittedKMeans.of(blocks.sparkSession, centres[best], float(cost[best]), int(taken[best]))

    def first_centres(self, blocks: DataFrame) -> list[np.ndarray]:
        """k-means||: rows drawn in a few steps by their squared distance, weighted by the rows nearest to them, and put into k centres
        by weighted k-means++.  Draws depend on the seed and a block's content."""
        seeds, k = self.seeds, self.k

        def one(x: np.ndarray, key: int) -> list:
            u = [np.random.default_rng([s, 0, key]).random(x.shape[1]) for s in seeds]
            return [(i, v.min(), x[:, v.argmin()]) for i, v in enumerate(u)]
        chosen = self._drawn(blocks, one)
        first = {i: min(((u, tuple(v)) for j, u, v in chosen if j == i)) for i in range(len(seeds))} if chosen else {}
        if not first:
            raise ValueError("no rows to cluster")
        centres = [np.array([first[i][1]]) for i in range(len(seeds))]
        for step in range(1, INIT_STEPS + 1):
            planes = [_planes([c]) for c in centres]

            def far(x: np.ndarray, planes=planes) -> np.ndarray:
                parts = [((p[:-1] ** 2).sum(0), [_nearest(p, q)[1][0] for q in planes]) for p in _chunks(x)]
                return np.concatenate([np.maximum(square - 2 * np.array(best), 0.0) for square, best in parts], 1)
            whole, = _added(blocks, lambda x, _, far=far: [far(x).sum(1)])

            def draw(x: np.ndarray, key: int, far=far, whole=whole, step=step) -> list:
                out = []
                for i, (s, away) in enumerate(zip(seeds, far(x), strict=True)):
                    u = np.random.default_rng([s, step, key]).random(x.shape[1])
                    out += [(i, u[at], x[:, at]) for at in np.flatnonzero(u * whole[i] < 2 * k * away)]
                return out
            more = self._drawn(blocks, draw)
            centres = [np.unique(np.array([*c, *(v for j, _, v in more if j == i)]), axis=0) for i, c in enumerate(centres)]
        weights = _added(blocks, lambda x, _, planes=[_planes([c]) for c in centres]: [
            sum(np.bincount(_nearest(p, q)[0][0], minlength=q.shape[0]) for p in _chunks(x)) for q in planes])
        return [c if len(c) <= k else self._plus_plus(c, w, s) for c, w, s in zip(centres, weights, seeds, strict=True)]

    @staticmethod
    def _drawn(blocks: DataFrame, draw: Callable) -> list[tuple[int, float, np.ndarray]]:
        """(restart, random number, row) of the rows that ``draw`` takes from each block."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, key in _blocks_in(batches):
                found = draw(x, key)
                yield pa.RecordBatch.from_arrays([pa.array([int(i) for i, _, _ in found], pa.int32()), pa.array([float(u) for _, u, _ in found], pa.float64()),
                                                  pa.array([v.tobytes() for _, _, v in found], pa.binary())], names=["i", "u", "x"])
        rows = blocks.mapInArrow(run, "i int, u double, x binary").toArrow().to_pylist()       # some 2k a restart and step
        return [(r["i"], r["u"], np.frombuffer(r["x"])) for r in rows]

    def _plus_plus(self, rows: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
        rng = np.random.default_rng([seed, INIT_STEPS + 1])
        at = [int(rng.choice(len(rows), p=weights / weights.sum()))]
        while len(at) < self.k:
            away = weights * ((rows[:, None] - rows[at][None]) ** 2).sum(2).min(1)
            if not away.sum() > 0:
                break
            at.append(int(rng.choice(len(rows), p=away / away.sum())))
        centres, label = rows[at].copy(), None
        for _ in range(LOCAL_ITER):
            before, label = label, ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            if before is not None and (before == label).all():
                break
            for j in range(len(centres)):
                w = weights * (label == j)
                if w.sum() > 0:
                    centres[j] = w @ rows / w.sum()
        return centres


def fit_kmeans(vectors: DataFrame, k: int, seeds=DEFAULT_SEEDS, max_iter: int = 300,
               tol: float = 1e-4) -> KMeansModel:                          # M05 / D19
    """Best of several seeded runs (least training cost, first seed on ties)."""
    blocks, path = packed(vectors)
    model = KMeans(k, tuple(seeds), max_iter, tol).fit(blocks)
    drop_scratch(vectors.sparkSession, path)
    return model


def silhouettes(blocks: DataFrame, models: list[FittedKMeans]) -> list[float]:
    """Mean silhouette by squared distances of each model, over all rows of a table of :func:`packed`.

    The mean squared distance of a row to the rows of a cluster follows from the cluster's size, sum and sum of squares.
    """
    planes = _planes([m.centres for m in models])
    k, m, d = planes.shape[0], planes.shape[1], planes.shape[2] - 1
    total = _added(blocks, _cluster_sums(planes))[0].reshape(m, k, d + 2).transpose(1, 0, 2)
    n = total[..., d]
    if ((n > 0).sum(0) < 2).any():
        raise ValueError("number of clusters must be greater than one")
    means = np.concatenate((-2 * total[..., :d], total[..., d + 1:]), 2) / np.maximum(n, 1)[..., None]

    def sums(x: np.ndarray, _: int) -> list[np.ndarray]:
        out = np.zeros(m)
        for part in _chunks(x):
            label = _nearest(part, planes)[0][None].astype(np.int64)
            far = (means.reshape(k * m, -1) @ part).reshape(k, m, -1) + (part[:d] ** 2).sum(0)
            far[n == 0] = np.inf
            rows = n[label[0], np.arange(m)[:, None]]
            own = np.take_along_axis(far, label, 0)[0] * rows / np.maximum(rows - 1, 1)
            np.put_along_axis(far, label, np.inf, 0)
            other = far.min(0)
            most = np.maximum(own, other)
            s = np.divide(other - own, most, out=np.zeros_like(own), where=most > 0)
            out += np.where(rows > 1, s, 0.0).sum(1)
        return [out]

    found, = _added(blocks, sums)
    return (found / n.sum(0)).tolist()


@dataclass
class SweepResult:
    table: list[tuple[int, float, float]]     # (k, inertia, silhouette)
    models: dict[int, KMeansModel]

    @property
    def best_k(self) -> int:                  # M07: greatest silhouette, smallest k on ties
        return sorted(self.table, key=lambda r: (-r[2], r[0]))[0][0]


def sweep(vectors: DataFrame, ks=K.K_RANGE, seeds=DEFAULT_SEEDS, max_iter: int = 300) -> SweepResult:   # M06
    blocks, path = packed(vectors)
    # A fit's iterations are short jobs in turn; the fits need nothing of each other.
    found = at_once([partial(KMeans(k, tuple(seeds), max_iter).fit, blocks) for k in ks], SWEEP_FITS)
    scores = silhouettes(blocks, found)
    drop_scratch(vectors.sparkSession, path)
    return SweepResult([(k, float(m.summary.trainingCost), s) for k, m, s in zip(ks, found, scores, strict=True)], dict(zip(ks, found, strict=True)))


def assign(model: KMeansModel, vectors: DataFrame, out: str = "cluster") -> DataFrame:   # M08
    return model.transform(vectors).withColumnRenamed("prediction", out)


def covariance(df: DataFrame, cols) -> DataFrame:                          # M09
    """(row, col, covariance) of every pair of columns, row <= col, by one aggregate of their population covariances."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = df.agg(*[F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"_{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), F.col(f"_{i}_{j}").alias("covariance"))
                                          for i, j in pairs])).alias("c")).select("c.*")


def principal_axes(cov: DataFrame, d: int, k: int = 2) -> np.ndarray:
    """(d, k) loadings of the k greatest variances; the first of a component's largest loadings is positive.

    Only the d x d covariances pass the driver.
    """
    m = np.zeros((d, d))
    for r in cov.collect():
        m[r["row"], r["col"]] = m[r["col"], r["row"]] = r["covariance"] or 0.0
    values, vectors = np.linalg.eigh(m)
    axes = vectors[:, np.argsort(-values, kind="stable")[:k]]
    size = np.abs(axes)
    first = np.argmax(size >= size.max(0) - 1e-9, axis=0)
    return axes * np.where(axes[first, np.arange(k)] < 0, -1.0, 1.0)


def project(df: DataFrame, cols, axes: np.ndarray, prefix: str = "pca") -> DataFrame:
    """``df`` with ``pca1`` .. : the columns' values along each axis."""
    return df.withColumns({f"{prefix}{j + 1}": reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in zip(cols, axes[:, j], strict=True)])
                           for j in range(axes.shape[1])})


def pca2(vectors: DataFrame, k: int = 2):                                 # M09
    """(frame with ``pca1``, ``pca2``, loadings): principal components of the (already centred) scaled vectors.

    Signs are fixed so that the first of a component's largest-magnitude loadings is
    positive, which makes the projection reproducible across engines.
    """
    d = vectors.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or len(vectors.first()["features"])
    cols = [f"_x{i}" for i in range(d)]
    wide = vectors.withColumn("_x", vector_to_array("features")).withColumns({c: F.col("_x")[i] for i, c in enumerate(cols)})
    axes = principal_axes(covariance(wide, cols), d, k)
    return project(wide, cols, axes).drop("_x", *cols), axes


def profile(df: DataFrame, cluster: str = "cluster", label: str = "success") -> DataFrame:   # A14
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in NUM_COLS], F.avg(label).alias(label),
                                   F.count(F.lit(1)).alias("count"))


def risk(df: DataFrame, cluster: str = "cluster", label: str = "success") -> DataFrame:   # A15
    return df.groupBy(cluster).agg(F.avg(label).alias("success_rate")) \
             .orderBy(F.desc("success_rate"), F.asc(cluster))
