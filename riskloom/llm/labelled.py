"""Folds by crc32 of the document id, and the bounded sample of labelled documents that a fit reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_bytes


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label, text) of about ``max_rows`` labelled documents at most, chosen by a hash of doc_id.

    The chosen ids are broadcast: their number is bounded by ``max_rows`` (and its sampling error).
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn_from)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    total = known.count()
    if total > max_rows:
        slots = 1 << 20
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < max(1, slots * max_rows // total))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(
        F.broadcast(known), "doc_id").select("doc_id", "label", "text")
