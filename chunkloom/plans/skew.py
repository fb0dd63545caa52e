"""Joining many rows to one row per key when a key may hold most of the rows.

Adaptive execution splits a skewed join only if both sides come straight from
an exchange.  A side that was just aggregated by the join key does not, so
those joins are salted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that may meet in one task.
ROWS_PER_COPY = 1_000_000


def join_salted(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread_by: Column,
    *,
    rows: str = "n",
    how: str = "inner",
    rows_per_copy: int | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` on ``key``; column ``rows`` of ``one`` says how many
    rows of ``many`` have the key, and is dropped.

    A key with more than ``rows_per_copy`` rows gets several copies of its one
    row, and its many rows choose among them by a hash of ``spread_by``.  There
    are at most (rows of ``many`` / ``rows_per_copy``) such keys, which bounds
    the broadcast that tells the many rows about them.
    """
    size = rows_per_copy or ROWS_PER_COPY
    copies = F.ceil(F.col(rows) / size).cast("int")
    hot = one.where(F.col(rows) > size).select(key, copies.alias("_copies"))
    left = many.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_copies")).cast("int"), F.lit(0)),
    )
    right = one.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))
    )
    return left.join(right, [key, "_salt"], how).drop("_salt", "_copies", rows)
