"""Substring dedup by hashing normalised units, with original offsets.

A text is cut into units that tile it.  A unit ends after a word that ends its line or paragraph, that
closes a sentence (``. ! ?``), whose hash is 0 modulo 16, or that is the 64th of the unit.  The cuts
depend on the words alone, so a passage is cut alike wherever it stands in a line.  Units are normalised (A-Z
lower-cased, white space between words ignored) and hashed to 64 bits; hash and word count are the
digest.

The digests are grouped over all documents (range-partitioned streams, ``runs``), the earliest
occurrence by (doc_id, offset) is kept, and every later one is a repeat.  Repeats that follow one
another without a gap in a document make a passage.  Passages of at least ``min_words`` words are
removed; shorter coincidences, such as a common short sentence, stay.  A chance collision of one
64-bit digest touches one unit and so does not make a passage.  Offsets are code points of the
original text, ends exclusive.

Rows: null or empty texts have no units.  A row without doc_id is a document of its own text and
ranks before all others.  Rows that share doc_id are one document: equal texts do not repeat one
another, and parts of different texts at the same offset are one place.  Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, doc_key, ints, mix64, record_batch, text_bytes, text_or_empty, word_hashes, written
from riskloom.llm.runs import later_occurrences

MAX_UNIT_WORDS = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".!?"]] = True


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, start, end) of each unit of a UTF-8 text; offsets in code points."""
    low = text.lower()
    words = low.split()
    if not words:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    h = word_hashes(words)
    raw = np.frombuffer(low, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.append(edge, len(raw))
    starts, ends = edge[::2], edge[1::2]
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    cut = _CLOSING[raw[ends - 1]] | (h % np.uint64(16) == 0)
    cut[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    cut[-1] = True
    first = np.concatenate(([0], np.flatnonzero(cut)[:-1] + 1))
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    first = np.flatnonzero(place % MAX_UNIT_WORDS == 0)
    count = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, count)
    digest = mix64(np.add.reduceat(mix64(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    begin = points[starts[first]]
    return digest.view(np.int64), count, begin, np.append(begin[1:], points[-1])


def _unit_rows(docs: DataFrame) -> DataFrame:
    def explode(batch: pa.RecordBatch) -> dict:
        found = [units(t.as_py()) for t in batch.column(1)]
        cols = [np.concatenate(c) if found else [] for c in zip(*found, strict=True)] or [[]] * 4
        return {"h1": cols[0], "h2": cols[1], "doc": np.repeat(ints(batch.column(0)), [len(f[0]) for f in found]),
                "pos": cols[2], "ends": cols[3]}

    rows = docs.select(doc_key().alias("doc"), text_bytes().alias("text"))
    return arrow_map(rows, "h1 long, h2 long, doc long, pos long, ends long", explode)


def _passages(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Sorted repeats (doc, pos, ends, words) to gap-free passages of enough words."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "start", "end", "n_words", "n_units")])
    doc = start = end = words = count = None
    for b in batches:
        out = []
        for d, p, e, w in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if d == doc and p == end:
                end, words, count = e, words + w, count + 1
            elif d == doc and p < end:
                continue  # the same place of a repeated row
            else:
                if doc is not None and words >= min_words:
                    out.append((doc, start, end, words, count))
                doc, start, end, words, count = d, p, e, w, 1
        if out:
            yield record_batch(schema, [list(c) for c in zip(*out, strict=True)])
    if doc is not None and words >= min_words:
        yield record_batch(schema, [[doc], [start], [end], [words], [count]])


def repeated_passages(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """doc, start, end, n_words, n_units of every passage to remove; ``doc`` is ``common.doc_key``."""
    rows = written(_unit_rows(docs), "units")
    repeats = later_occurrences(rows, ["ends"]).select("doc", "pos", "ends", F.col("h2").alias("words"))
    return (repeats.repartition("doc").sortWithinPartitions("doc", "pos", "ends")
            .mapInArrow(lambda batches: _passages(batches, min_words),
                        "doc long, start long, end long, n_words long, n_units long"))


def remove_repeats(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """``docs`` with its repeated passages cut out of ``text``; all rows and columns stay."""
    spans = repeated_passages(docs, min_words).groupBy(F.col("doc").alias("__doc")).agg(
        F.sort_array(F.collect_list(F.array("start", "end"))).alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text, spans):
            if spans is None:
                return text
            out, at = [], 0
            for a, b in spans:
                out.append(text[at:a])
                at = b
            return "".join([*out, text[at:]])
        return texts.combine(spans, one)

    return (docs.withColumn("__doc", doc_key()).join(spans, "__doc", "left")
            .withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(
                cut(text_or_empty(), "__spans"))).select(*docs.columns))
