"""Exploring the chunk table: pages, look-ups, grouped statistics, histograms.

Every function takes any DataFrame, so the same plans serve chunks and
catalogs.  All of them keep filter and projection declarative: both reach the
Parquet scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.plans.filters import QueryError, where

# Bounds of the request arguments.
PAGE_LIMIT = (1, 1000)
BINS = (1, 100)
METRICS = (1, 20)
DEFAULT_LIMIT = 100
DEFAULT_BINS = 10

_OPS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def _bounded(name: str, value: int, bounds: tuple[int, int]) -> None:
    if not bounds[0] <= value <= bounds[1]:
        raise QueryError(f"{name} must be between {bounds[0]} and {bounds[1]}")


def _column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise QueryError(f"unknown column: {name}")
    return F.col(f"`{name}`")


def _behind(order: tuple[str, ...], after: tuple) -> Column:
    """Rows behind a key in ascending order; NULLs come first and so never lie behind."""
    found, same = F.lit(False), F.lit(True)
    for name, value in zip(order, after):
        found = found | (same & (F.col(name) > F.lit(value)))
        same = same & (F.col(name) == F.lit(value))
    return found


def query(
    chunks: DataFrame,
    predicate: str | None = None,
    columns: list[str] | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    order: tuple[str, ...] = ("source_id", "chunk_id"),
    after: tuple | None = None,
) -> DataFrame:
    """One page of matching rows, in a fixed order.

    Columns that were not asked for come back NULL; the key is always kept.  An
    ``offset`` passes over rows that it still has to order; ``after``, the order
    columns of the last row seen, starts behind that row by a filter instead, at
    any depth for the price of one page.
    """
    _bounded("limit", limit, PAGE_LIMIT)
    if offset < 0:
        raise QueryError("offset must not be negative")
    rows = where(chunks, predicate)
    if after is not None:
        if len(after) != len(order) or any(v is None for v in after):
            raise QueryError(f"after needs a value for each of {', '.join(order)}")
        rows = rows.where(_behind(order, after))
    if columns:
        for c in columns:
            _column(chunks, c)
        kept = set(columns) | {"chunk_id"}
        keys = [F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)]
        rows = (
            rows.select(*[c for c in chunks.columns if c in kept], *keys)
            .orderBy(*[f"_order_{i}" for i in range(len(order))])
            .offset(offset)
            .limit(limit)
        )
        return rows.select(
            *[
                F.col(f.name) if f.name in kept else F.lit(None).cast(f.dataType).alias(f.name)
                for f in chunks.schema.fields
            ]
        )
    return rows.orderBy(*order).offset(offset).limit(limit)


def total(chunks: DataFrame, predicate: str | None = None) -> DataFrame:
    """Number of all matching rows, whatever the page."""
    return where(chunks, predicate).agg(F.count(F.lit(1)).alias("total"))


def lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The row of one chunk id; the id is bound as a value, not as SQL text."""
    return chunks.where(F.col("chunk_id") == F.lit(chunk_id)).limit(1)


def lookup_many(chunks: DataFrame, requested: DataFrame) -> DataFrame:
    """All requested chunk ids with a ``found`` flag and their row."""
    hits = chunks.withColumn("_hit", F.lit(True))
    return (
        requested.select("chunk_id")
        .distinct()
        .join(hits, "chunk_id", "left")
        .withColumn("found", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def _metric(df: DataFrame, spec: str) -> Column:
    if spec == "count":
        return F.count(F.lit(1)).alias("count")
    op, colon, name = spec.partition(":")
    if not colon:
        raise QueryError(f"invalid metric: {spec!r}")
    if op not in _OPS:
        raise QueryError(f"unknown metric operation: {op!r}")
    if not name:
        raise QueryError(f"metric {spec!r} names no column")
    value = _column(df, name)
    if op in ("sum", "mean") and isinstance(df.schema[name].dataType, T.FloatType):
        value = value.cast("double")
    return _OPS[op](value).alias(f"{op}_{name}")


def aggregate(
    chunks: DataFrame, group_by: str, metrics: list[str], predicate: str | None = None
) -> DataFrame:
    """Statistics per value of one column; NULL is a group of its own."""
    _bounded("number of metrics", len(metrics), METRICS)
    key = _column(chunks, group_by)
    specs = [_metric(chunks, m) for m in metrics]
    return where(chunks, predicate).groupBy(key).agg(*specs)


def numeric_distribution(df: DataFrame, column: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """Equal-width histogram: bucket, lower, upper, count.

    NULLs are left out; no value gives no bucket; one distinct value gives one
    bucket; buckets are half-open except the last.  One pass finds the range,
    a second one counts; only one row and at most ``bins`` rows leave them.
    """
    _bounded("bins", bins, BINS)
    spark = df.sparkSession
    values = df.select(_column(df, column).cast("double").alias("x")).where("x IS NOT NULL")
    low, high, n, nans = values.agg(
        F.min("x"), F.max("x"), F.count("x"), F.count_if(F.isnan("x"))
    ).first()
    schema = "bucket int, lower double, upper double, count bigint"
    if n == 0:
        return spark.createDataFrame([], schema)
    if nans or math.isinf(low) or math.isinf(high):
        raise QueryError(f"column {column!r} holds values without a finite range")
    if low == high:
        return spark.createDataFrame([(0, low, high, n)], schema)

    width = high - low
    step = width / bins
    edges = [low + step * i for i in range(bins)] + [high]
    edge = F.array(*[F.lit(e) for e in edges])
    guess = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width * bins)).cast("int")
    # The division may round across an edge: settle by comparing with the edges.
    bucket = (
        F.when(F.col("x") < F.get(edge, F.col("guess")), F.col("guess") - 1)
        .when(
            (F.col("x") >= F.get(edge, F.col("guess") + 1)) & (F.col("guess") < bins - 1),
            F.col("guess") + 1,
        )
        .otherwise(F.col("guess"))
    )
    counts = (
        values.withColumn("guess", guess)
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = spark.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)],
        "bucket int, lower double, upper double",
    )
    return frame.join(counts, "bucket", "left").select(
        "bucket", "lower", "upper", F.coalesce("n", F.lit(0)).alias("count")
    )


def categorical_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first; NULL is a bucket of its own."""
    return (
        df.groupBy(_column(df, column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("value"))
    )


def distribution(
    chunks: DataFrame, column: str, bins: int = DEFAULT_BINS, predicate: str | None = None
) -> DataFrame:
    """Histogram of one column, numeric or categorical by its type."""
    _column(chunks, column)
    kind = chunks.schema[column].dataType
    rows = where(chunks, predicate)
    if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)):
        return numeric_distribution(rows, column, bins)
    if isinstance(kind, T.StringType):
        return categorical_distribution(rows, column)
    raise QueryError(f"column {column!r} of type {kind.simpleString()} has no distribution")
