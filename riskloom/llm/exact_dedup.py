"""Exact dedup with skew-safe combining, in DataFrame operations only.

Two texts are equal when they are identical after lower-casing A-Z.  Three stages, each of which
compares whole texts and not only digests:

1. local: the grouping key is (digest, salt, text), so the map-side half of the aggregation merges
   the copies inside a task before anything is shuffled;
2. salted: copies of one text meet in ``salts`` groups per digest, chosen by doc_id, so a text held
   by a third of all rows is spread over that many tasks;
3. global: the winners of the salts (at most ``salts`` rows per text) are combined by (digest, text).

Only rows whose digest occurs more than once carry their text through these stages.

Rows: null text counts as empty.  Of equal texts the row with the largest doc_id stays (null ids are
smaller than any id).  Rows that share text and doc_id are one document and share the ``kept`` flag;
each is counted in ``group_size``.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_or_empty, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that, and faster, when every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(text_or_empty()).alias("body"))
    base = base.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    ids = written(base.select("doc_id", "digest"), "exact-ids")
    shared = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")

    copies = written(base.join(shared, "digest", "left_semi"), "exact-copies")
    salted = copies.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "body").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"),
                                                   F.sum("n").alias("group_size"))
    # A skewed text on the copies' side of this join is split by adaptive execution: winners are unique.
    in_groups = copies.join(winners, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "digest")
    alone = ids.join(shared, "digest", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return alone.unionByName(in_groups).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""
