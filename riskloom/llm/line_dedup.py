"""Line dedup by range-partitioned line hashes.

Each line's key (the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased) is hashed
to 128 bits.  The hashes are range-partitioned with a secondary sort by document and position and
streamed (``runs``); what comes back is a zlib-compressed bitmap of kept lines per document, never
text.  The texts are joined with their bitmaps once, at the end.

``rule="first"`` keeps the first occurrence of a key by (document, position); ``rule="frequent"``
drops every line whose key is found in at least ``min_docs`` documents.  ``rule="boilerplate"`` drops
the same lines, but three lines on end (or a whole text of fewer) that are found in at least
``min_docs`` documents are copied text: of each key in them the earliest such (document, position)
stays, so one of a large group of copies keeps its text.  Lines without a key do not count here.  Keys shorter than
``min_chars`` code points are always kept.

Rows: a null or empty text is one empty line.  Rows that share a doc_id are one document for the
count; a row without doc_id is a document of its own text.  Repeated rows get equal results.  Extra
columns pass through ``apply_bitmaps`` untouched.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, doc_key, give_back, mix64, shuffled, text_bytes, text_or_empty, written
from riskloom.llm.runs import frequent_occurrences, later_occurrences

_BLANK = b" \t\n\x0b\x0c\r"


_WINDOWS = ["window0", "window1", "window2"]


def _windows(h: list[int]) -> list[list[int]]:
    """For the keys of a text, the hashes of the runs of three that each is the third, second and first of; 0 for none.

    A text of one or two keys is one run of its own kind.
    """
    u, n = np.array(h, np.uint64), len(h)
    size = min(n, 3)
    joint = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        joint = mix64(joint * np.uint64(3) + u[i:n - size + i + 1])
    joint = joint.view(np.int64).tolist()
    if n < 3:
        return [[0] * n, [0] * n, joint * n]
    return [[0, 0, *joint], [0, *joint, 0], [*joint, 0, 0]]


def line_hashes(docs: DataFrame, min_chars: int, windows: bool = False) -> DataFrame:
    """h1, h2, doc, pos, body (hash of the row's text) for every line that has a key; ``windows`` adds ``_windows``."""
    names = ["h1", "h2", "doc", "pos", "body", *(_WINDOWS if windows else [])]

    def explode(batch: pa.RecordBatch) -> dict:
        h1, h2, doc, pos, body, *runs = ([] for _ in names)
        for d, b, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            first = len(h1)
            for i, line in enumerate(t.split(b"\n")):
                key = line.strip(_BLANK).lower()
                if not key or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
                    continue
                h = xxhash.xxh3_128_intdigest(key)
                h1.append(h >> 64)
                h2.append(h & 0xFFFFFFFFFFFFFFFF)
                doc.append(d)
                pos.append(i)
                body.append(b)
            if runs and len(h1) > first:
                for run, w in zip(runs, _windows(h1[first:]), strict=True):
                    run += w
        u = [np.array(x, np.uint64).view(np.int64) for x in (h1, h2)]
        return dict(zip(names, [*u, *(np.array(x, np.int64) for x in (doc, pos, body, *runs))], strict=True))

    rows = docs.select(doc_key().alias("doc"), F.xxhash64(text_or_empty()).alias("body"), text_bytes().alias("text"))
    return arrow_map(rows, ", ".join(f"{n} long" for n in names), explode)


def _first_in_copies(frequent: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, doc, pos: the earliest place of each frequent key that stands in copied text.

    All by aggregates that combine before the shuffle; a run in ``min_docs`` documents has frequent keys only.
    """
    runs = frequent.select("h1", "h2", "doc", "pos", F.explode(F.array(*_WINDOWS)).alias("run")).where("run <> 0")
    copied = (runs.groupBy("run", "h1", "h2", "doc").agg(F.min("pos").alias("pos"))
              .groupBy("run", "h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc", "pos")).alias("at"))
              .where(F.col("docs") >= min_docs))
    return copied.groupBy("h1", "h2").agg(F.min("at").alias("at")).select("h1", "h2", "at.doc", "at.pos")


def keep_bitmaps(docs: DataFrame, rule: str = "frequent", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc, body, bitmap: for each document that loses a line, a compressed bitmap of dropped positions.

    Bit i (little-endian) is 1 where line i goes; documents without a row keep all their lines.
    """
    hashes = written(line_hashes(docs, min_chars, rule == "boilerplate"), "line-hashes")
    if rule == "first":
        gone = later_occurrences(hashes, ["body"])
    elif rule == "frequent":
        gone = frequent_occurrences(hashes, min_docs, ["body"])
    elif rule == "boilerplate":
        gone = frequent_occurrences(hashes, min_docs, ["body", *_WINDOWS])
        gone = gone.join(shuffled(_first_in_copies(gone, min_docs)), ["h1", "h2", "doc", "pos"], "left_anti")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    # A document's lines are bounded by the document, so this list is too.
    lists = gone.groupBy("doc", "body").agg(F.collect_set("pos").alias("pos"))

    def pack(batch: pa.RecordBatch) -> dict:
        maps = []
        for pos in batch.column(2):
            p = pos.values.to_numpy(zero_copy_only=False)
            bits = np.zeros(int(p.max()) + 1, np.uint8)
            bits[p] = 1
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        return {"doc": batch.column(0), "body": batch.column(1), "bitmap": maps}

    return arrow_map(lists, "doc long, body long, bitmap binary", pack)


def dropped_positions(bitmap: bytes | None) -> np.ndarray:
    if bitmap is None:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little"))


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """(lines before, lines dropped, kept lines joined by a line feed)."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    gone = set(dropped_positions(bitmap).tolist())
    return len(lines), len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``__bitmap`` (null: all lines stay); the text travels once."""
    return (docs.withColumn("__doc", doc_key()).withColumn("__body", F.xxhash64(text_or_empty()))
            .join(bitmaps.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"),
                                 F.col("bitmap").alias("__bitmap")), ["__doc", "__body"], "left")
            .drop("__doc", "__body"))


def line_dedup_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row."""
    rows = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, **options)).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), "__bitmap")

    def digest(batch: pa.RecordBatch) -> dict:
        out = [kept_text(t.as_py(), b.as_py()) for t, b in zip(batch.column(1), batch.column(2), strict=True)]
        return {"doc_id": batch.column(0), "n_lines": [x[0] for x in out], "n_dropped": [x[1] for x in out],
                "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in out]}

    return arrow_map(rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", digest)


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; rows left without any character go.

    ``n_chars`` follows the new text if the table has it; rows that lose nothing are unchanged.
    """
    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            for text, bitmap in batches:
                yield text.combine(bitmap, lambda t, b: None if b is None else kept_text(t.encode(), b)[2].decode())
        finally:
            give_back()

    loses = F.col("__bitmap").isNotNull()
    rows = with_bitmaps(docs, keep_bitmaps(docs, **options))
    # Only texts that lose a line go to Python.
    rows = rows.withColumn("__cut", cut(F.when(loses, F.col("text")), "__bitmap"))
    rows = rows.where(~loses | (F.char_length("__cut") > 0)).withColumn("text", F.when(loses, F.col("__cut")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(loses, n_chars).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""
