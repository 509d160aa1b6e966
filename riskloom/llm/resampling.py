"""Target-distribution importance resampling by array-scored weights and an exact threshold.

1. *Features.*  Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lower-cased text; features are all
   runs of 1 to ``longest`` words, joined by one space, hashed by crc32 into ``buckets``.  One job each
   counts the buckets of the corpus and of the target texts; a task sends one row for each bucket.
2. *Weights.*  A bucket's gain is the floored, scaled log ratio of its add-one-smoothed frequencies.  The
   gains are one array of ``buckets`` numbers in every task; a document's weight is the floored mean
   over its features.  The Gumbel noise of its id makes the highest scores a draw without replacement.
3. *Threshold.*  The scores are persisted.  Repeated exact count jobs over (score) narrow the range of
   the cutoff score, each counting at ``PROBES`` places, and then that of doc_id among the rows
   tied at the cutoff, until exactly the wanted number of rows is above.  Only counts pass the driver.
4. *Ranks.*  The selected rows are range-partitioned by (score, doc_id); their places are their ranks.

Rows: a null or empty text has no features and weight 0; it counts for the draw only if ``min_words`` is 0.
Ties in score go to the smaller doc_id, rows without doc_id last (they share the noise of the text
``<seed>:``).  Repeated rows are separate candidates with ranks of their own.  Other columns are not
read by ``resampling`` and pass through ``resampled_documents``.  An empty table gives no rows; an
empty target makes all its smoothed frequencies equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, text_bytes, text_or_empty, tidy, written
from riskloom.llm.ordering import numbered

BUCKETS = 10_000
LONGEST = 2
SEED = 7
MIN_WORDS = 20
PERCENT = 25
PROBES = 16
LAST_ID = (1 << 63) - 1
_FLUSH = 1 << 20
# A-Z to a-z; digits, a-z and all bytes of longer characters stay; the rest separates words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each feature) of a whole text."""
    words = text.translate(_WORD_BYTES).split()
    runs = list(map(crc32, words))
    found = [runs]
    for size in range(1, min(longest, len(words))):
        # crc32 goes on where it stopped: the run, a space, the next word
        runs = list(map(crc32, words[size:], map(crc32, repeat(b" "), runs)))
        found.append(runs)
    return len(words), np.concatenate([np.array(x, np.int64) for x in found]) % buckets


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(features(text.as_py(), longest, buckets)[1])
                size += len(held[-1])
                if size >= _FLUSH:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    rows = texts.select(text_bytes().alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed frequencies) of each bucket, in doubles."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    total, wanted, n = float(source.sum()), float(target.sum()), len(s)
    return np.floor(1000 * np.log((t + 1) * (total + n) / ((s + 1) * (wanted + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a standard Gumbel number) from the hash of ``<seed>:<doc_id>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED, more: list[Column] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score (and the columns ``more``) for every row."""
    names = [f"__more{i}" for i in range(len(more))]

    def weigh(batch: pa.RecordBatch) -> dict:
        words, n, weight = [], [], []
        for text in batch.column(1):
            w, b = features(text.as_py(), longest, len(gain))
            words.append(w)
            n.append(len(b))
            weight.append(int(gain[b].sum()) // len(b) if len(b) else 0)
        out = {"doc_id": batch.column(0), "n_words": words, "n_features": n, "weight": weight}
        return out | {name: batch.column(2 + i) for i, name in enumerate(names)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"),
                       *(c.cast("long").alias(x) for c, x in zip(more, names, strict=True)))
    schema = "doc_id long, n_words long, n_features long, weight long" + "".join(f", {x} long" for x in names)
    return arrow_map(rows, schema, weigh).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def least_with(counts, low: int, high: int, wanted: int) -> int:
    """The least x in [low, high] with at least ``wanted`` rows at or below it.

    ``counts(places)`` gives, by one job, the number of rows at or below each place; ``high`` has enough.
    """
    while low < high:
        step = max(1, (high - low) // PROBES)
        places = list(range(low, high, step))[:PROBES + 1]
        enough = [p for p, n in zip(places, counts(places), strict=True) if n >= wanted]
        high = min([high, *enough])
        low = max([low, *(p + 1 for p in places if p < high and p not in enough)])
    return low


def cutoff(rows: DataFrame, wanted: int) -> tuple[int, int]:
    """(score, doc_id): exactly ``wanted`` rows (score, key) are above the score, or at it with at most that key.

    Rows that share score and key with the last of them come on top.  ``wanted`` is above 0 and at most the rows' number.
    """
    def at_most(column: str, where: DataFrame):
        def counts(places: list[int]) -> list[int]:
            return list(where.agg(*[F.count(F.when(F.col(column) <= p, 1)) for p in places]).first())
        return counts

    falling = rows.withColumn("__neg", -F.col("score"))
    low, high = falling.agg(F.min("__neg"), F.max("__neg")).first()
    score = -least_with(at_most("__neg", falling), low, high, wanted)
    above = rows.where(F.col("score") > score).count()
    tied = rows.where(F.col("score") == score)
    low, high = tied.agg(F.min("__key"), F.max("__key")).first()
    return score, least_with(at_most("__key", tied), low, high, wanted - above)


def drawn(rows: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` rows (as a written table) with ``rank``: 1, 2, 3 .. of the drawn ones, null for the others."""
    rows = rows.withColumn("__key", F.coalesce("doc_id", F.lit(LAST_ID)))
    eligible = F.col("n_words") >= min_words
    wanted = percent * rows.where(eligible).count() // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return rows.withColumn("rank", none).drop("__key")
    score, key = cutoff(rows.where(eligible).select("score", "__key"), wanted)
    chosen = eligible & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("__key") <= key)))
    # Copies of the last row may be among the chosen ones beyond ``wanted``.
    ranked = numbered(rows.where(chosen).withColumn("__salt", F.monotonically_increasing_id()),
                      [F.desc("score"), "__key", "n_features", "weight", "__salt"], "__place").drop("__salt")
    ranked = ranked.withColumn("rank", F.when(F.col("__place") < wanted, F.col("__place") + 1)).drop("__place")
    return rows.where(~chosen).withColumn("rank", none).unionByName(ranked).drop("__key")


def _scores(docs: DataFrame, target: DataFrame, longest: int, buckets: int, seed: int, more: list[Column]) -> DataFrame:
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return written(scored(docs, gain, longest, seed, more), "importance")


def resampling(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, longest: int = LONGEST,
               buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; ``target`` has a column ``text``."""
    return drawn(_scores(docs, target, longest, buckets, seed, []), min_words, percent).select(
        "doc_id", "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT,
                        longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with their columns.  Of rows that share doc_id and text, all stay if one is drawn."""
    body = F.xxhash64(text_or_empty())
    ranks = drawn(_scores(docs, target, longest, buckets, seed, [body]), min_words, percent).where("rank IS NOT NULL")
    wanted = ranks.select(F.col("doc_id").alias("__id"), F.col("__more0").alias("__body")).distinct()
    return docs.join(wanted.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(wanted["__id"]) & (body == wanted["__body"]), "left_semi")


SQL = f"""
WITH RECURSIVE bits(i, step, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
texts AS (SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM texts),
f AS (SELECT kind, row, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w),
v AS (SELECT feature, hex(encode(feature)) AS hx FROM (SELECT DISTINCT feature FROM f)),
h AS (SELECT feature, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(hx) // 2),
             lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]))) % {BUCKETS} AS bucket FROM v, crc),
g AS (SELECT kind, row, bucket FROM f JOIN h USING (feature)),
n AS (SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM g GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {BUCKETS}.0::DOUBLE)
                / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {BUCKETS}.0::DOUBLE)))) AS gain FROM n),
per AS (SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
        FROM g JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row),
sc AS (SELECT doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5)
              / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN per USING (row) WHERE kind = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (WHERE words >= {MIN_WORDS}) OVER () AS eligible FROM sc)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN words >= {MIN_WORDS} AND place <= {PERCENT} * eligible // 100 THEN place END AS rank FROM r
"""
