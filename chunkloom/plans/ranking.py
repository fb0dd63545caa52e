"""Ranks and previous values inside groups that may be very large.

A plain window sorts each group in one task.  These forms spread one group
over many tasks and only carry small per-task summaries between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.session import materialize


def _place(df: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """Range-partition by ``keys`` and note each row's range in ``_part``.

    Ranges are cut by sampled quantiles, so they are even however the rows are
    spread over groups; the written table pins which rows each range holds.
    """
    spark = df.sparkSession
    n = parts or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    return materialize(
        df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranges"
    )


def rank_in_group(
    df: DataFrame, group: list[str], order: list[str], name: str, parts: int | None = None
) -> DataFrame:
    """0-based position of each row in its group by ``order`` (no ties).

    Each range numbers its own rows; the rows of earlier ranges are added as an
    offset from one count per (group, range).
    """
    placed = _place(df, group + order, parts)
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.withColumn("_pos", F.row_number().over(local) - 1)
        .join(offsets, [*group, "_part"])
        .withColumn(name, (F.col("_pos") + F.col("_skip")).cast("bigint"))
        .drop("_part", "_pos", "_skip")
    )


def totals_in_group(
    df: DataFrame, group: list[str], order: list[str], totals: dict[str, str], parts: int | None = None
) -> DataFrame:
    """For each name in ``totals``, the sum of its column over the rows before, in the order of a group.

    Ranges sum up their own rows; what earlier ranges hold of a group is one number for each
    of them.  Ties of ``order`` may stand in any order.  Groups must not be null.
    """
    placed = _place(df, group + order, parts)
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = placed.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    skipped = skipped.select(
        *group, "_part", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_skip_{n}") for n in totals]
    )
    summed = placed.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in totals.items()})
    return summed.join(skipped, [*group, "_part"]).select(
        *df.columns, *[(F.col(f"_own_{n}") + F.col(f"_skip_{n}")).cast("bigint").alias(n) for n in totals]
    )


def previous_in_group(
    df: DataFrame, key: str, order: list[str], value: str, name: str, parts: int | None = None
) -> DataFrame:
    """The previous row's ``value`` in the order of one key (no ties).

    Windows cover one (key, range); from range to range only the last value of
    a key is passed on.
    """
    placed = _place(df, [key, *order], parts)
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    across = Window.partitionBy(key).orderBy("_part")
    carried = (
        placed.groupBy(key, "_part")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .drop("_last")
    )
    return (
        placed.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_lag", F.lag(value).over(inside))
        .join(carried, [key, "_part"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_part", "_first", "_lag", "_carried")
    )
