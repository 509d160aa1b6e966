"""Join helpers: byte-checked broadcast and lookup joins.

A side is broadcast only when its size is proven: either it is bounded by
construction (a top-k frame, a fixed dimension) or it passed
:func:`bounded_broadcast`'s check of its bytes.  Beyond the bound the join stays a
shuffle join and adaptive execution (skew-join splitting on) handles hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import reliable_checkpoint

#: Bytes of a side that every executor may be sent; its hash table takes some times as much.
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 16


def _column_bytes(f: T.StructField) -> Column:
    """Bytes of a value as it is held in memory: 8, and the text or list behind it."""
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(8)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + F.lit(8)
    return F.lit(8)


def frame_bytes(df: DataFrame) -> int:
    """Bytes of all rows, by one aggregate."""
    row = F.lit(_ROW_BYTES)
    for f in df.schema.fields:
        row = row + _column_bytes(f)
    return int(df.agg(F.sum(row.cast("bigint")).alias("b")).first()["b"] or 0)


def bounded_broadcast(small: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``small`` if its rows take at most ``max_bytes``, else return it for a shuffle join.

    The frame is checkpointed to the shared folder, so the check and the join read the
    same rows and nothing stays cached.  Typical inputs are per-key aggregates, whose shuffle is
    already cut down by partial aggregation.
    """
    small = reliable_checkpoint(small)
    return F.broadcast(small) if frame_bytes(small) <= max_bytes else small.hint("merge")


def lookup_join(big: DataFrame, lookup: DataFrame, on, how: str = "left",
                max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Join a per-key lookup table onto a large frame."""
    return big.join(bounded_broadcast(lookup, max_bytes), on, how)
