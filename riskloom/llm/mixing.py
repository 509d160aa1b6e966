"""Mixing sources to target weights by index.

1. *Targets.*  Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the size (in
   words) of the whole corpus.  A target stops at ``max_repeats`` times its source's size; the excess
   is shared again by weight until none is above.
2. *Blocks.*  The documents of a source, laid end to end, are packed into blocks of ``block_words``
   words.  A document's place is a prefix sum, taken in two levels over about sqrt(n) hash buckets of
   documents per source, so that a source with a third of all rows is no single task.
3. *Draws.*  The slots of the mix are cut into output shards of ``shard_slots``.  Each shard draws its
   source counts from a multinomial distribution, conditioned on the exact slot totals of the
   sources (that is, multivariate hypergeometric): a binary tree over the shards halves the totals at
   random, seeded by the node, so that every shard finds its counts, and how many slots of each source
   went before it, alone.
4. *Permutations.*  Slot j of a source is block ``p(j mod n)`` of the source's n blocks, ``p`` being a
   keyed pseudorandom permutation (a Feistel network with cycle walking) that changes with every pass
   j div n.  No block is drawn more than ``max_repeats`` times, so no document exceeds that either.
5. Blocks join their draws by (source, block); a document takes its words of each block as often as
   that was drawn.

The number of slots stays below ``MAX_SLOTS``: a corpus of more than ``MAX_SLOTS * block_words`` words has
longer blocks.  Per-source totals (one row a source) pass the driver; nothing of documents does.
Everything is a function of the data and ``seed``: reruns agree, whatever the partitioning.

Rows: null or blank texts have size 0 and take 0.  A null source is a source of its own.  Documents are
ordered by (bucket, doc_id or a number made of the text, hash of the text), so rows without doc_id spread
and keep their order; repeated rows are separate documents with places of their own.  Extra columns pass through ``mixed_documents``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, doc_key, give_back, mix64, shuffled, text_or_empty, tidy, written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_SLOTS = 500_000_000
_WORD_RE = re.compile(WORD)


def targets(sizes: list[int], weights=WEIGHTS, max_repeats: int = 3) -> list[float]:
    """Target words of each source, in their order, for their sizes in words."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = max_repeats * np.array(sizes, float)
    out, free, left = np.zeros(len(w)), np.ones(len(w), bool), float(sum(sizes))
    while free.any() and left > 0:
        share = left * w / w[free].sum()
        over = free & (share > cap)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out.tolist()


def slot_totals(sizes: list[int], wanted: list[float], block_words: int, max_repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, slots) of each source; slots carry the source's mean block length."""
    size = np.array(sizes, np.float64)
    blocks = np.ceil(size / block_words).astype(np.int64)
    slots = np.rint(np.divide(np.array(wanted) * blocks, size, out=np.zeros(len(size)), where=size > 0)).astype(np.int64)
    return blocks, np.minimum(slots, max_repeats * blocks)


def shard_draw(shard: int, shards: int, slots: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in this shard, slots of each source in the shards before it)."""
    lo, hi, here, before = 0, shards, slots.copy(), np.zeros_like(slots)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(
            here, (mid - lo) * shard_slots, method="marginals")
        if shard < mid:
            hi, here = mid, left
        else:
            before += left
            lo, here = mid, here - left
    return here, before


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size), applied to an array of indices."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    keys = mix64(np.arange(4, dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo &= out >= np.uint64(size)
    return out.astype(np.int64)


def _placed(docs: DataFrame, block_words: int, max_repeats: int, weights):
    """(rows with source_no, size, source_size, target, start; blocks; slots; block length)."""
    keys = [doc_key().alias("__doc"), F.xxhash64(text_or_empty()).alias("__body")]
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *keys,
                                F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    block_words = max(block_words, -(-sum(sizes) // MAX_SLOTS))
    wanted = targets(sizes, weights, max_repeats)
    blocks, slots = slot_totals(sizes, wanted, block_words, max_repeats)

    numbers = docs.sparkSession.createDataFrame(
        [(r.source, i, r["size"], t) for i, (r, t) in enumerate(zip(totals, wanted, strict=True))],
        "name string, source_no int, source_size long, target double")
    if len(totals) <= 100_000:
        numbers = F.broadcast(numbers)
    rows = sized.join(numbers, sized["source"].cast("string").eqNullSafe(numbers["name"])).drop("name", "source")
    buckets = max(1, math.isqrt(sum(r.n for r in totals)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("__doc", "__body"), F.lit(buckets)))
    firsts = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("held")).withColumn(
        "first", F.sum("held").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("held")).drop("held")
    inside = Window.partitionBy("source_no", "bucket").orderBy("__doc", "__body").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = (rows.withColumn("until", F.sum("size").over(inside)).join(firsts, ["source_no", "bucket"])
            .withColumn("start", F.col("first") + F.col("until") - F.col("size")).drop("bucket", "until", "first"))
    return rows, blocks, slots, block_words


def _draws(spark, blocks: np.ndarray, slots: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, block, times): a row per drawn block, so it grows with the corpus.  Its size cannot be
    estimated from the range of shards it is made of; join it as ``shuffled``."""
    shards = max(1, -(-int(slots.sum()) // shard_slots))

    @tidy
    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                count, before = shard_draw(int(shard), shards, slots, shard_slots, seed)
                for s in np.flatnonzero(count):
                    j = np.arange(before[s], before[s] + count[s])
                    passes = j // blocks[s]
                    for p in np.unique(passes):
                        own = j[passes == p] - p * blocks[s]
                        yield pd.DataFrame({"source_no": np.int32(s), "block": permute(
                            own, int(blocks[s]), seed * 0x9E3779B1 + int(s) * 1_000_003 + int(p))})

    return (spark.range(0, shards, 1, max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
            .mapInPandas(draw, "source_no int, block long")
            .groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times")))


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """Rows (.., block, lo, hi): the words of a document (numbered in it) that lie in each of its blocks."""
    size, start = F.col("size"), F.col("start")
    return (rows.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(start / block_words), F.floor((start + size - 1) / block_words))))
            .withColumn("lo", F.greatest(F.col("block") * block_words - start, F.lit(0)))
            .withColumn("hi", F.least((F.col("block") + 1) * block_words - start, size)))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeats: int = 3,
        weights=WEIGHTS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, start for every row; ``start`` is its place in its source."""
    rows, blocks, slots, length = _placed(docs, block_words, max_repeats, weights)
    rows = written(rows.drop("__doc", "__body"), "placed")
    drawn = _draws(docs.sparkSession, blocks, slots, shard_slots, seed)
    kept = ["doc_id", "size", "source_size", "target"]
    some = _pieces(rows, length).join(shuffled(drawn), ["source_no", "block"], "left").groupBy(*kept, "source_no", "start").agg(
        F.sum((F.col("hi") - F.col("lo")) * F.coalesce("times", F.lit(0))).alias("taken"))
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = [*kept, "taken", "start"]
    return some.select(out).unionByName(none.select(out))


def copies(text: str, parts: list[tuple[int, int, int]], max_repeats: int) -> list[str]:
    """Copy r holds, in order, the words of the parts (lo, hi, times) that were drawn at least r times."""
    if len({t for _, _, t in parts}) == 1:
        return [text] * parts[0][2]
    at = [m.start() for m in _WORD_RE.finditer(text)]
    at = [0, *at[1:], len(text)]
    out = ("".join(text[at[lo]:at[hi]] for lo, hi, t in parts if t >= r) for r in range(1, max_repeats + 1))
    return [x for x in out if x]


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeats: int = 3,
                    weights=WEIGHTS, seed: int = 17) -> DataFrame:
    """The mix as documents with the columns of ``docs``: up to ``max_repeats`` copies of each document.

    Copy r keeps the words, with the white space after them, of the blocks drawn at least r times; copies without words are left out.
    ``n_chars`` follows the text if the table has it.
    """
    rows, blocks, slots, length = _placed(docs, block_words, max_repeats, weights)
    drawn = _draws(docs.sparkSession, blocks, slots, shard_slots, seed)
    # The parts of one row are bounded by the row; repeated rows keep lists of their own.
    parts = _pieces(rows, length).join(shuffled(drawn), ["source_no", "block"], "left").groupBy("__doc", "__body", "source_no", "start").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", F.coalesce("times", F.lit(0)).alias("times")))).alias("__parts"))
    parts = parts.where(F.exists("__parts", lambda p: p["times"] > 0)).select("__doc", "__body", "__parts")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            for texts, lists in batches:
                yield pd.Series([copies(t, [(p["lo"], p["hi"], p["times"]) for p in ps], max_repeats)
                                 for t, ps in zip(texts, lists, strict=True)], dtype=object)
        finally:
            give_back()

    own = docs.withColumns({"__doc": doc_key(), "__body": F.xxhash64(text_or_empty())}).dropDuplicates(["__doc", "__body"])
    out = own.join(parts, ["__doc", "__body"]).withColumn("text", F.explode(cut("text", "__parts")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
