"""Boosted trees against a plain loop over rows, and exact quantiles against numpy."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.ml import boosting as B
from riskloom.ml import cluster as CL
from riskloom.operators import quantiles as Q
from riskloom.session import scratch_path


def data(n, classes, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.randrange(6), rng.choice([0.0, 1.0]), round(rng.random(), 2)]
        score = x[0] + 2 * x[1] + 3 * x[2] + rng.random()
        rows.append((i, int(score * classes / 11) % classes, 1.0 + i % 3, x))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, y, w, Vectors.dense(x)) for i, y, w, x in rows], ["id", "y", "w", "features"]).repartition(parts)


def plain_fit(rows, classes, p):
    """Margins of all rows after p.rounds, by exhaustive search over all thresholds, one node after the other."""
    columns = 1 if classes == 2 else classes
    m = [[0.0] * columns for _ in rows]
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0.0), g)

    def grow(at, g, h, depth):
        gs, hs = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (1e-6, None)
        if depth:
            for f in range(len(rows[0][3])):
                for t in sorted({rows[i][3][f] for i in at}):
                    left = [i for i in at if rows[i][3][f] <= t]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if hl < p.least_child or hs - hl < p.least_child:
                        continue
                    gain = soft(gl) ** 2 / (hl + p.l2) + soft(gs - gl) ** 2 / (hs - hl + p.l2) - soft(gs) ** 2 / (hs + p.l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, t))
        if best[1] is None:
            return {i: -p.step * soft(gs) / (hs + p.l2) for i in at}
        f, t = best[1]
        return grow([i for i in at if rows[i][3][f] <= t], g, h, depth - 1) | grow([i for i in at if rows[i][3][f] > t], g, h, depth - 1)

    for _ in range(p.rounds):
        steps = []
        for c in range(columns):
            g, h = {}, {}
            for i, (_, y, w, _) in enumerate(rows):
                if columns == 1:
                    q = 1 / (1 + math.exp(-m[i][0]))
                    g[i], h[i] = w * (q - y), w * q * (1 - q)
                else:
                    e = [math.exp(v) for v in m[i]]
                    q = e[c] / sum(e)
                    g[i], h[i] = w * (q - (y == c)), w * 2 * q * (1 - q)
            steps.append(grow(list(range(len(rows))), g, h, p.depth))
        for c, s in enumerate(steps):
            for i, v in s.items():
                m[i][c] += v
    return m


@pytest.mark.parametrize("classes, l1, l2, least", [(2, 0.1, 1.0, 1.0), (3, 0.0, 1.0, 1.0), (3, 1.0, 2.0, 3.0)])
def test_fit_against_a_plain_loop(spark, classes, l1, l2, least):
    rows = data(90, classes)
    p = B.Boosting(rounds=3, step=0.3, depth=3, l1=l1, l2=l2, least_child=least)
    df = frame(spark, rows)
    model = B.fit(df, "y", ["id"], p, classes, weight="w")
    got = {r.id: r for r in model.transform(df).select("id", "prediction", vector_to_array("rawPrediction").alias("m"),
                                                       vector_to_array("probability").alias("p")).collect()}
    want = plain_fit(rows, classes, p)
    for (i, *_), m in zip(rows, want, strict=True):
        assert np.allclose(got[i].m[-len(m):], m, atol=1e-5)
        assert abs(sum(got[i].p) - 1) < 1e-9 and got[i].prediction == np.argmax(got[i].p)


def same(a, b):
    return len(a.rounds) == len(b.rounds) and all(
        np.array_equal(s[k], t[k]) for x, y in zip(a.rounds, b.rounds, strict=True) for s, t in zip(x, y, strict=True) for k in s)


def test_model_does_not_depend_on_partitions(spark):
    """More rounds than one table of margins holds, with rows and features sampled."""
    rows = data(400, 3, 5)
    p = B.Boosting(rounds=B.REBASE + 2, step=0.1, depth=4, rows=0.7, features=0.7, l1=0.1)
    one = B.fit(frame(spark, rows, 1), "y", ["id"], p, 3)
    many = B.fit(frame(spark, rows[::-1], 7), "y", ["id"], p, 3)
    assert same(one, many) and len(one.rounds) == B.REBASE + 2
    assert abs(one.featureImportances.toArray().sum() - 1) < 1e-9
    assert any(not np.array_equal(s["feature"], t["feature"]) for s, t in zip(one.rounds[0], one.rounds[1], strict=True))


def test_many_values_are_cut_into_bins(spark):
    rows = [(i, int(i > 700), 1.0, [float(i), 0.0, 1.0]) for i in range(1000)]
    df = frame(spark, rows)
    cuts = B.feature_cuts(df.select(vector_to_array("features").alias("x")), 3, 16)
    assert len(cuts[0]) == 15 and list(cuts[1]) == [0.0] and max(np.diff(cuts[0])) <= 1000 / 15 + 1
    model = B.fit(df, "y", ["id"], B.Boosting(rounds=5, step=0.5, depth=2, bins=16))
    wrong = model.transform(df).where(F.col("prediction") != F.col("y")).count()
    assert wrong <= 1000 / 15 + 1


def test_penalties_and_empty_tables(spark):
    df = frame(spark, data(60, 2))
    heavy = B.fit(df, "y", ["id"], B.Boosting(rounds=2, l1=1e6))
    assert all(len(t["left"]) == 1 and t["value"][0] == 0 for trees in heavy.rounds for t in trees)
    none = B.fit(df.where(F.lit(False)), "y", ["id"], B.Boosting(rounds=2))
    assert none.rounds == [] and {r.p[1] for r in none.transform(df).select(vector_to_array("probability").alias("p")).collect()} == {0.5}


def test_save_and_load(spark):
    df = frame(spark, data(120, 3))
    model = B.fit(df, "y", ["id"], B.Boosting(rounds=3, depth=3), 3)
    path = scratch_path(spark, f"boosted-{uuid.uuid4().hex[:8]}")
    model.save(spark, path)
    assert same(model, B.BoostedTrees.load(spark, path))


def test_exact_quantile_against_numpy(spark):
    rng = random.Random(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", None if i % 13 == 0 else rng.choice([7.5, float(rng.randrange(50))]))
            for i in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        got = {r.g: r.quantile for r in Q.exact_quantile(df, "v", q, by="g").collect()}
        assert set(got) == {g for g, _ in rows} and got["none"] is None
        for g in set(got) - {"none"}:
            assert math.isclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], q), abs_tol=1e-12)
        whole = Q.exact_quantile(df, "v", q).collect()
        assert math.isclose(whole[0].quantile, np.quantile([v for _, v in rows if v is not None], q), abs_tol=1e-12)
    assert Q.exact_quantile(df.where(F.lit(False)), "v", 0.5, by="g").collect() == []


def test_only_one_of_two_siblings_is_summed_from_rows(spark, monkeypatch):
    asked, summed = [], B._level_sums
    monkeypatch.setattr(B, "_level_sums", lambda *a: (asked.append([int(s.max()) + 1 for s in a[2]]), summed(*a))[1])
    rows, p = data(400, 3, 5), B.Boosting(rounds=2, step=0.1, depth=4, least_child=0.0)
    one, many = (B.fit(frame(spark, rows, n), "y", ["id"], p, 3) for n in (1, 7))
    assert same(one, many)
    assert len(asked) == 2 * 2 * 4
    for i, nodes in enumerate(asked):
        assert max(nodes) <= max(1, 2 ** (i % 4 - 1))


def test_kmeans_unpacks_its_rows_once(spark, monkeypatch):
    """A fit on a persisted frame would read it again in each iteration."""
    df = frame(spark, data(200, 3, 5), 3)
    levels, fit = [], CL.KMeans.fit
    monkeypatch.setattr(CL.KMeans, "fit", lambda self, vectors: (levels.append(vectors.storageLevel), fit(self, vectors))[1])
    swept = CL.sweep(df, (2, 3), (1,), 5)
    assert [k for k, _, _ in swept.table] == [2, 3] and swept.best_k in swept.models
    assert len(levels) == 2 and not any(v.useMemory or v.useDisk for v in levels)


def test_sums_of_few_partitions_need_no_shuffle(spark, monkeypatch):
    rows, p = data(300, 3), B.Boosting(rounds=3, step=0.3, depth=3)
    monkeypatch.setattr(B, "PARTITION_ROWS", 60)
    margins, shuffles = [], []
    for most in (1 << 20, 0):
        monkeypatch.setattr(B, "GATHERED_SUMS", most)
        own = type(spark.range(1))
        old, made = own.repartition, []
        monkeypatch.setattr(own, "repartition", lambda self, *a: made.append(a) or old(self, *a))
        model = B.fit(frame(spark, rows, 4), "y", ["id"], p, 3)
        monkeypatch.setattr(own, "repartition", old)
        shuffles.append(sum("bin" in a for a in made))
        margins.append(B.margins(np.array([x for *_, x in rows], float), model.rounds, 3))
    assert shuffles[0] == 0 < shuffles[1] and np.array_equal(*margins)


def test_a_few_rows_need_no_job_a_level(spark, monkeypatch):
    """The driver's own rounds over one block give the model of the distributed ones, and old tables of rows are dropped."""
    rows, p = data(400, 3, 5), B.Boosting(rounds=B.REBASE + 2, step=0.1, depth=4, rows=0.7, features=0.7, l1=0.1)
    kinds, dropped, summed, drop = [], [], B._level_sums, B.drop_scratch
    monkeypatch.setattr(B, "_level_sums", lambda *a: (kinds.append(type(a[0])), summed(*a))[1])
    monkeypatch.setattr(B, "drop_scratch", lambda spark, path: (dropped.append(path), drop(spark, path))[1])
    few = B.fit(frame(spark, rows), "y", ["id"], p, 3)
    assert set(kinds) == {list} and not dropped
    monkeypatch.setattr(B, "GATHERED_ROWS", 100)
    monkeypatch.setattr(B, "PARTITION_ROWS", 100)
    kinds.clear()
    many = B.fit(frame(spark, rows), "y", ["id"], p, 3)
    assert list not in kinds and len(dropped) == 2 and same(few, many)


def test_features_that_go_together_share_a_byte(spark, monkeypatch):
    """One-hot columns and functions of one value are packed; a guess that some row breaks is taken back."""
    rng = random.Random(2)
    values = [(rng.randrange(6), rng.randrange(200), rng.randrange(200)) for _ in range(900)]
    rows = [(i, int(a in (1, 4) or b > 150), 1.0, [float(a == j) for j in range(6)] + [float(a), math.sin(a), float(b), float(c)])
            for i, (a, b, c) in enumerate(values)]
    df = frame(spark, rows)
    x = df.select(vector_to_array("features").alias("x"))
    cuts = B.feature_cuts(x, 10, 256)
    packing = B._Packing.of(x, cuts)
    assert sorted(f for m in packing.members for f in m) == list(range(10)) and len(packing.members) == 3
    monkeypatch.setattr(B, "_GUESS_ROWS", 40)                    # so few that both wide features seem to fit into one byte
    proved = B._Packing.of(x, cuts)
    assert all(len(k) <= 256 for k in proved.keys) and proved.column[8] != proved.column[9]
    binned = np.stack([np.searchsorted(c, [r[3][f] for r in rows], "left").astype(np.uint8) for f, c in enumerate(cuts)])
    for p in (packing, proved):
        bytes_ = p.packed(binned)
        assert all(np.array_equal(p.bins[f][bytes_[p.column[f]]], binned[f]) for f in range(10))
    p = B.Boosting(rounds=4, step=0.3, depth=3, features=0.8)
    models = [B.fit(df, "y", ["id"], p)]
    monkeypatch.setattr(B._Packing, "of", classmethod(lambda cls, rows, cuts: cls.alone(np.array([len(c) + 1 for c in cuts]))))
    models.append(B.fit(df, "y", ["id"], p))
    assert same(*models)
