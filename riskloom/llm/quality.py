"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Each feature of a text is cut into at most ``BINS`` quantile bins.  Cyclic boosting visits the features in turn; on
each visit a shallow tree (at most ``LEAVES`` leaves, so intervals of bins) is fitted to the gradient
of the log loss and added, shrunken, to that feature's lookup table.  When the main effects are done,
the pairs of features whose coarse grids explain most of the remaining gradient get tables of their
own (``PAIRS`` of them, trees that cut both axes), boosted cyclically in the same way.  A score is the
intercept plus one table entry per feature and pair: bin numbers by ``searchsorted``, tables by vectorised
lookups and additions.

The fit reads at most about ``max_rows`` labelled rows (default 20,000; chosen by a hash of doc_id; a bound on the fit
alone) with ``len(FEATURES)`` numbers each, on the driver; the model is a few thousand numbers.  Every
row is scored over its whole text.

Features come from the text only.  Rows: a null or empty text has all features 0 and a score like any
other.  Null labels are ignored, repeated labels of a document averaged and rounded.  Extra columns
are not read.  An empty table gives no rows; without labels all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, give_back, text_bytes
from riskloom.llm.labelled import fold, sample

MAX_ROWS = 20_000
BINS, COARSE, LEAVES, PAIRS = 32, 8, 3, 10
FEATURES = ("log_words", "log_lines", "word_length", "upper", "digit", "punctuation", "sign", "non_ascii", "closing",
            "signed_words", "distinct_words", "top_word", "distinct_lines", "words_per_line", "long_words",
            "short_words", "repeated_pairs", "capital_words")
_PUNCT = [ord(c) for c in ".,;:!?'\"()-"]
_SIGN = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _PUNCT]
_CLOSE = [ord(c) for c in ".!?"]
_LETTERS_END = bytes(c for c in range(128) if not chr(c).isalnum())


def features(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, int(hist.sum() - hist[[9, 10, 11, 12, 13, 32]].sum()))
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x]
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    counts = np.bincount(codes)
    pairs = np.sort(codes[:-1] * len(number) + codes[1:])
    signed = sum(w[-1] in _SIGN_SET for w in number)
    capital = sum(int(counts[i]) for w, i in number.items() if 65 <= w[0] <= 90)
    return [np.log1p(n), np.log1p(len(lines)), float(length.mean()), hist[65:91].sum() / size, hist[48:58].sum() / size,
            hist[_PUNCT].sum() / size, hist[_SIGN].sum() / size, hist[128:].sum() / size, hist[_CLOSE].sum() / n,
            signed / len(number), len(number) / n, int(counts.max()) / n, len(set(lines)) / max(1, len(lines)),
            n / max(1, len(lines)), float((length > 12).mean()), float((length < 3).mean()),
            float((pairs[1:] == pairs[:-1]).sum()) / max(1, n - 1), capital / n]


_SIGN_SET = frozenset(_SIGN)


@dataclass
class Gam:
    """Cuts per feature, one table per feature, and one per pair of features."""

    cuts: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            out += g[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -35, 35)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, int]:
    """(gain, cut) of the best split of consecutive bins; bins below ``cut`` go left."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= least) & (n.sum() - nl >= least), gain, 0.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Step per bin of a tree of at most LEAVES leaves, grown best split first."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        found = [(*_best_cut(g[a:b], h[a:b], n[a:b], least), a, b) for a, b in leaves]
        gain, cut, a, b = max(found)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = _step(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Step per cell of a tree that cuts one axis and then each side across the other."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        gain, cut = _best_cut(g.sum(1 - axis), h.sum(1 - axis), n.sum(1 - axis), least)
        step, total = np.zeros_like(g), gain
        for side in (slice(0, cut), slice(cut, None)):
            where = (side, slice(None)) if axis == 0 else (slice(None), side)
            a, b, c = (x[where].sum(axis) for x in (g, h, n))
            gain, across = _best_cut(a, b, c, least)
            total += gain
            tree = np.empty(len(a))
            tree[:across] = _step(a[:across].sum(), b[:across].sum())
            tree[across:] = _step(a[across:].sum(), b[across:].sum())
            step[where] = tree[None, :] if axis == 0 else tree[:, None]
        if total > best:
            best, out = total, step
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15) -> Gam:
    """Cyclic boosting of main effects, then of the best pairs; deterministic for given rows."""
    model = Gam([np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y) or y.min() == y.max():
        model.intercept = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    b, least = model.bins(x), max(3, len(y) // 2000)
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradient()
            step = rate * shallow_tree(*(np.bincount(b[:, j], w, len(table)) for w in (g, h, None)), least)
            table += step
            f += step[b[:, j]]

    def cells(i, j, weight):
        shape = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], weight, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    coarse = [(len(t) + COARSE - 1) // COARSE for t in model.tables]
    worth = []
    for i in range(x.shape[1]):
        for j in range(i):
            key = (b[:, i] // coarse[i]) * COARSE + b[:, j] // coarse[j]
            gg, hh = np.bincount(key, g, COARSE * COARSE), np.bincount(key, h, COARSE * COARSE)
            worth.append((float(_gain(gg, hh).sum()), j, i))
    model.pairs = [(j, i) for _, j, i in sorted(worth, reverse=True)[:PAIRS]]
    model.grids = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            g, h = gradient()
            step = rate * pair_tree(cells(i, j, g), cells(i, j, h), cells(i, j, None), least)
            grid += step
            f += step[b[:, i], b[:, j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, learn_from, label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """The model of the labelled documents that ``learn_from`` (a Column of doc_id) admits."""
    chosen = sample(docs, labels, learn_from, label, max_rows)

    def extract(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "label": batch.column(1), "x": [features(t.as_py()) for t in batch.column(2)]}

    rows = sorted(arrow_map(chosen, "doc_id long, label int, x array<double>", extract).collect())
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.label for r in rows], np.float64))


def with_score(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                x = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
                yield pd.Series(sent.value.score(x))
        finally:
            give_back()

    return docs.withColumn(name, score(text_bytes()))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.5,
            max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learnt from the folds that are not held out."""
    model = learn(docs, labels, fold("doc_id", folds) != held_out, max_rows=max_rows)
    rows = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
