"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of anything but ASCII punctuation and white space, A-Z lower-cased.  Features of a text,
each 0 or 1: its words and their stems (first 5 and 7 bytes) found at least once, twice and four times;
its word pairs; and its pairs with one word skipped between them.  All are hashed to ``2**BITS`` slots.
FTRL-proximal keeps per-coordinate learning rates and an L1 penalty, so that nearly all coordinates stay
exactly 0; the learnt weights go to the tasks as a sparse (slot, weight) broadcast variable of at most
``2**BITS`` entries.

Labels are learnt from about ``max_rows`` labelled rows at most (default 8,000), chosen by a hash of
doc_id; this bounds the fit alone.  Every row is scored over its whole text.

Rows: a null or empty text, or one without words, has the bias as its only feature.  Labels that are
null are ignored, repeated labels of a document are averaged and rounded; labels of unknown documents
and documents without label teach nothing.  Extra columns are not read.  An empty table gives no
rows; without labels all scores are 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, counted, distinct, mix64, text_bytes, word_hashes, written
from riskloom.llm.labelled import fold, sample

BITS = 20
MAX_ROWS = 8_000
MAX_SLOTS = 24_000_000
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_STEMS = (5, 7)


def _stems(line: bytes, words: list[bytes]) -> list[np.ndarray]:
    """For each stem length the hashes of the words' first bytes; ``line`` is the words joined by one byte."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(line + bytes(8), np.uint8)
    head = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))[starts].copy().view("<u8").ravel()
    bits = [np.minimum(size, k).astype(np.uint64) * np.uint64(8) for k in _STEMS]
    return [mix64((head & ((np.uint64(1) << b) - np.uint64(1))) + np.uint64(k)) for k, b in zip(_STEMS, bits, strict=True)]


_MASK = (1 << BITS) - 1


def _again(slots: np.ndarray, times: int) -> np.ndarray:
    """Slots of "found ``times`` or more" for the slots of words or stems."""
    return (slots * 0x9E3779B1 + times * 0x85EBCA77 >> 7) & _MASK


class Live:
    """By slot: whether its weight is not 0, and whether that of itself or of its repeats is not."""

    def __init__(self, weights: np.ndarray):
        self.own = weights != 0
        slots = np.arange(1 << BITS)
        self.any = self.own | self.own[_again(slots, 2)] | self.own[_again(slots, 4)]


def features(text: bytes, live: Live | None = None) -> np.ndarray:
    """Distinct slots of a text's features, without slot 0, the bias.

    ``live`` leaves out slots without weight before the costly counting.
    """
    words = text.translate(_FOLD).split()
    if not words:
        return np.empty(0, np.int64)
    h = word_hashes(words)
    shift = np.uint64(64 - BITS)

    def slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> shift).astype(np.int64)

    pairs = [slots(mix64(h[:-1] * np.uint64(3) + h[1:])), slots(mix64(h[:-2] * np.uint64(5) + h[2:] + np.uint64(1)))]
    out = [p if live is None else p[live.own[p]] for p in pairs]
    for kind in (h, *_stems(b" ".join(words), words)):
        found = slots(kind)
        if live is not None:
            found = found[live.any[found]]
        found, times = counted(found)
        out += [found, _again(found[times >= 2], 2), _again(found[times >= 4], 4)]
    out = distinct(np.concatenate(out))
    return out[out > 0] if live is None else out[(out > 0) & live.own[out]]


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression (McMahan et al. 2013) over 0/1 features."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, slots: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[slots]
        grown = n + g * g
        self.z[slots] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = grown

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at]


def _turn(doc_id: int) -> tuple[int, int]:
    """The place of a document in the order of the fit: a hash of its id."""
    return int(mix64(np.array([doc_id]).view(np.uint64))[0]), doc_id


def fit(rows: list[tuple[int, np.ndarray, int]], passes: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights from (doc_id, slots, label) rows, visited in a hashed order of doc_id."""
    model = Ftrl(l1=max(1.0, 0.4 * len(rows) ** 0.5))
    rows = sorted(rows, key=lambda r: _turn(r[0]))
    for _ in range(passes):
        for _, slots, label in rows:
            model.update(np.append(slots, 0), label)
    return model.sparse()


def learn(docs: DataFrame, labels: DataFrame, learn_from, label: str = "toxic", max_rows: int = MAX_ROWS,
          max_slots: int = MAX_SLOTS):
    """Sparse weights learnt from the labelled documents that ``learn_from`` (a Column of doc_id) admits.

    The driver gathers about ``max_rows`` documents at most and of these, in a hashed order, as many as have
    ``max_slots`` features (4 bytes each) together.
    """
    chosen = sample(docs, labels, learn_from, label, max_rows)

    def extract(batch: pa.RecordBatch) -> dict:
        found = [features(t.as_py()) for t in batch.column(2)]
        return {"doc_id": batch.column(0), "label": batch.column(1),
                "slots": [f.astype(np.int32).tobytes() for f in found]}

    found = written(arrow_map(chosen, "doc_id long, label int, slots binary", extract), "toxic-slots")
    # At most about max_rows sizes; they say how far the slots may be gathered.
    sizes = found.select("doc_id", (F.octet_length("slots") / 4).cast("long").alias("n")).collect()
    held, last = 0, None
    for turn, n in sorted((_turn(r.doc_id), r.n) for r in sizes):
        held += n
        if held > max_slots:
            break
        last = turn
    rows = [(r.doc_id, r.label, r.slots) for r in found.join(F.broadcast(docs.sparkSession.createDataFrame(
        [(r.doc_id,) for r in sizes if last is not None and _turn(r.doc_id) <= last], "doc_id long").distinct()), "doc_id").collect()]
    return fit([(i, np.frombuffer(bytes(slots), np.int32), y) for i, y, slots in rows])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    ready = []  # once for each task

    def run(batch: pa.RecordBatch) -> dict:
        if not ready:
            dense = np.zeros(1 << BITS)
            dense[sent.value[0]] = sent.value[1]
            ready.extend((dense, Live(dense)))
        dense, live = ready
        out = []
        for t in batch.column(1):
            out.append(1 / (1 + np.exp(-np.clip(dense[0] + dense[features(t.as_py(), live)].sum(), -35, 35))))
        return {"doc_id": batch.column(0), "score": np.array(out, np.float64)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return arrow_map(rows, "doc_id long, score double", run)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3,
             max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learnt from the folds that are not held out."""
    weights = learn(docs, labels, fold("doc_id", folds) != held_out, max_rows=max_rows)
    return score(docs, weights).select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
