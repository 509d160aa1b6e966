"""Last-wins upsert by key.

``update_or_create`` applied row by row means: per key, the last row seen
wins.  Here the old table and the new batch are unioned with a batch number
and, per key, the row with the greatest ``(batch, *order_cols)`` is kept via
``max_by`` in a grouped aggregate.  The aggregate combines partially on the
map side, so a key repeated in a third of the rows is reduced before the
shuffle; a ``row_number`` window would instead sort every row of that key in
one task.  ``dropDuplicates`` is wrong here: it keeps an arbitrary (first)
row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_last_wins(batches: list[DataFrame], keys: list[str], order_cols: list[str] | None = None,
                     drop: tuple[str, ...] = ()) -> DataFrame:
    """Resolve ``batches`` (oldest first) to one row per key.

    ``order_cols`` give the order of rows inside a batch (the sheet order, as
    the sheet readers' ``sequence`` column states it); a batch without such a
    column counts as before all numbered rows, and sequence columns named in
    ``drop`` do not come back.  Rows equal in the batch number and every order column are
    interchangeable only if they are equal in every column, so pass all
    non-key columns when no sequence column exists.
    """
    tagged = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=bool(drop)), tagged)
    payload = [c for c in u.columns if c not in keys and c != "_batch" and c not in drop]
    order_cols = order_cols if order_cols is not None else payload
    order = F.struct(F.col("_batch"), *[F.col(c) for c in order_cols])
    best = u.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])
