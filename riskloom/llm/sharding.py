"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard i of weight w draws, for a record's key, the number ``-ln(u) / w`` with u in (0, 1) from
``md5("<key>:<i>")``; the record goes to the shard with the smallest draw (ties: the smaller number).  A
shard wins a share of the keys that is proportional to its weight, and a record's shard is a function
of its key and the weights alone: no table of records, no order, no other record has a say.  Adding
a shard changes no other draw, so rows only move into the new one; taking the last one away moves
only its own rows; raising a weight moves rows only into that shard.

``slots`` numbers the rows of each shard from 0 without gaps, in order of (doc_id, nulls last, crc,
size), by a range partitioning over (shard, doc_id, ..), so a shard is never one task.

Keys: doc_id; a row without doc_id has the digest of its text as its key, so equal texts without id go
together.  Repeated rows go to the same shard, each with a slot of its own.  A null text has size
1 and crc32 0, as an empty one.  Other columns are not read by ``assigned`` and pass through
``write_shards``; a column named ``shard`` there is replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_or_empty, written
from riskloom.llm.ordering import numbered

SHARDS = 16
_HEX, _RANGE = 13, 1 << 52


def record_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(doc_id).cast("long").cast("string"),
                      F.concat(F.lit("text:"), F.md5(text_or_empty(text).cast("binary"))))


def draw(key: Column, shard: int, weight: float) -> Column:
    """The draw of one shard for a key; the smallest draw takes the record."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(_RANGE))
    return -F.ln(u) / F.lit(float(weight))


def _winner(key: Column, weights: list[float], shards: range | None = None) -> Column:
    """struct(draw, shard) of the winning shard; shards of weight 0 take nothing."""
    shards = range(len(weights)) if shards is None else shards
    draws = [F.struct(draw(key, i, weights[i]).alias("draw"), F.lit(i).alias("shard")) for i in shards if weights[i] > 0]
    if not draws or min(weights) < 0:
        raise ValueError("weights must not be negative, and some shard must have one above 0")
    return F.array_min(F.array(*draws))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (int) of a string key among shards 0 .. len(weights) - 1."""
    return _winner(key, weights)["shard"]


def assigned(docs: DataFrame, weights: list[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard for every row; ``grown_shard`` is its shard once one more
    shard, of weight ``new_weight``, stands at the end."""
    weights = [1.0] * SHARDS if weights is None else list(weights)
    body = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), record_key().alias("__key"))
    rows = rows.withColumn("__won", _winner(F.col("__key"), weights))
    extra = draw(F.col("__key"), len(weights), new_weight)
    return rows.select("doc_id", "size", "text_crc32", F.col("__won.shard").alias("shard"),
                       F.when(extra < F.col("__won.draw"), F.lit(len(weights))).otherwise(F.col("__won.shard")).alias("grown_shard"))


def slots(rows: DataFrame) -> DataFrame:
    """``assigned`` rows with ``slot`` (long): gapless from 0 in each shard.  The texts are read once and not shuffled."""
    rows = written(rows, "assigned")
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}  # one row a shard
    starts, at = {}, 0
    for shard in sorted(counts):
        starts[shard], at = at, at + counts[shard]
    order = ["shard", F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "__salt"]
    # Equal keys would share a range; a salt lets even one repeated row spread over several tasks.
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    first = rows.sparkSession.createDataFrame(list(starts.items()), "__shard int, __first long")
    return numbered(salted, order, "__place").join(F.broadcast(first), F.col("shard") == F.col("__shard")).withColumn(
        "slot", F.col("__place") - F.col("__first")).drop("__salt", "__place", "__shard", "__first")


def sharding(docs: DataFrame, weights: list[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law ``key``."""
    return slots(assigned(docs, weights, new_weight)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def moved(docs: DataFrame, before: list[float], after: list[float]) -> DataFrame:
    """Rows of ``docs`` whose shard differs between two lists of weights, with ``from_shard`` and ``to_shard``."""
    key = record_key()
    return docs.withColumns({"from_shard": shard_of(key, before), "to_shard": shard_of(key, after)}).where(
        "from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float] | None = None) -> None:
    """Write the rows of ``docs`` under ``path``, a folder ``shard=<i>`` for each shard.

    The rows are spread by (shard, text hash), so a shard is written by as many tasks as it needs.
    """
    rows = docs.withColumn("shard", shard_of(record_key(), [1.0] * SHARDS if weights is None else list(weights)))
    (rows.withColumn("__spread", F.xxhash64(record_key())).repartitionByRange("shard", "__spread").drop("__spread")
     .write.partitionBy("shard").parquet(path))


def sql(shards: int = SHARDS) -> str:
    """DuckDB text of ``sharding`` with equal weights; crc32 goes byte by byte over a table made from its rule."""
    return f"""
WITH RECURSIVE bits(i, step, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
d AS (SELECT doc_id, text, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx,
             coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(hx) // 2),
             lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]))) AS text_crc32 FROM d, crc),
s AS (SELECT *, list_transform(range({shards + 1}), lambda i:
             -ln((CAST('0x' || substr(md5(key || ':' || i), 1, {_HEX}) AS BIGINT) + 0.5) / {_RANGE}.0)) AS draws FROM c),
a AS (SELECT doc_id, size, text_crc32, list_position(draws[:{shards}], list_min(draws[:{shards}])) - 1 AS shard,
             list_position(draws, list_min(draws)) - 1 AS grown FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS BIGINT) AS slot,
       CAST(grown AS INT) AS grown_shard FROM a
"""
