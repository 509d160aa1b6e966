"""Helpers shared by the corpus operators: table access, lineage cuts, row identity, word shingles.

Words are the maximal runs of code points outside ``[\\x20\\x09-\\x0D]``; on UTF-8 bytes that is
exactly what ``bytes.split()`` yields, and ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
# (setting, Spark's default, ours).  Batches for Python are cut by bytes too, as texts have any length, and shuffle files
# go when their job ends, since the jobs here end in written tables.
_SETTINGS = (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"),
             ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true"))


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators are made for, where it still has Spark's defaults."""
    for name, default, own in _SETTINGS:
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, own)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared checkpoint folder."""
    spark = prepared(df.sparkSession)
    path = scratch_path(spark, os.path.join("llm", f"{name}-{uuid.uuid4().hex}"))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more, so that later tables do not lie beside it."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    return text_or_empty(col).cast("binary")


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A non-null long for a row: its doc_id, or a negative number made of the text's hash."""
    return F.coalesce(F.col(doc_id).cast("long"),
                      F.lit(-1) - F.pmod(F.xxhash64(text_or_empty(text)), F.lit(2 ** 62)))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a shuffle join at every size: for sides that grow with the corpus, so that no
    size estimate makes the driver gather them."""
    return df.hint("merge")


MARK_BITS = 1 << 24


def with_likely(df: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``df`` with ``flag``: false for rows whose ``key`` is surely not in ``wanted`` (one column of that name).

    The keys mark bits of a map of ``MARK_BITS`` bits, kept as 64-bit words: at most ``MARK_BITS / 64``
    rows (4 MB), whatever the size of ``wanted``, so it can be broadcast.  A full map flags all rows.
    """
    def bit(k):
        return F.pmod(F.xxhash64(k), F.lit(MARK_BITS))

    marks = wanted.select(bit(key).alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(__bit & 63 as int))")).alias("__marks"))
    asked = df.withColumn("__bit", bit(key)).withColumn("__word", F.shiftright("__bit", 6))
    hit = F.expr("coalesce((__marks & shiftleft(1L, cast(__bit & 63 as int))) <> 0, false)")
    return asked.join(F.broadcast(marks), "__word", "left").select(*df.columns, hit.alias(flag))


def likely_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``wanted``: a superset, before a shuffle."""
    return with_likely(df, key, wanted, "__likely").where("__likely").drop("__likely")


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task, and so would what it used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(fn):
    """A generator over batches that gives its memory back when its task ends."""
    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


PORTION_BYTES = 4 << 20


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``PORTION_BYTES`` (one row at least), as batches are cut by rows, whatever their texts."""
    step = max(1, batch.num_rows * PORTION_BYTES // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """``mapInArrow`` for a function from one part of a batch to a dict of equally long columns."""
    spark_schema = T.StructType.fromDDL(schema)
    names = spark_schema.fieldNames()
    target = to_arrow_schema(spark_schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                out = fn(part)
                if out is not None:
                    yield record_batch(target, [out[n] for n in names])

    return df.mapInArrow(run, spark_schema)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is faster than numpy's hashing ``unique`` here."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    if not len(x):
        return x, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], np.diff(np.append(first, len(x)))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), element-wise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                               0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of the A-Z-lower-cased text.

    A text with fewer words is one shingle; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(width, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc += mix64(h[i:i + n]) * _ODD[i]
    return distinct(mix64(acc))
