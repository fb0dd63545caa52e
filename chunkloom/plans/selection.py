"""Choosing chunks for a data set: originals, sources, samples, mixes, comparisons.

Samples are ordered by a digest of seed and chunk id, so they are the same on
every run and every cluster.  Ranks are limited per collection before the
shuffle (a rank filter on a window), so a large collection sends no more than its quota from each task.
"""

from __future__ import annotations

import math
from fractions import Fraction
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.plans.filters import QueryError, predicate_column, where
from chunkloom.plans.ranking import rank_in_group


def originals(chunks: DataFrame, *, include_augmented: bool = False) -> DataFrame:
    """Chunks cut from documents; derived ones too where asked for."""
    return chunks if include_augmented else chunks.where("augmented_from IS NULL")


def heads(chunks: DataFrame) -> DataFrame:
    """One chunk of each near-duplicate cluster: its head.  Chunks that were not compared yet are not kept."""
    return chunks.where("attr_minhash_is_head")


def of_sources(
    chunks: DataFrame, sources: DataFrame, predicate: str | None = None, collections: list[int] | None = None
) -> DataFrame:
    """Chunks whose source lies in one of ``collections`` and matches ``predicate``.

    ``sources(id, collection_id, ...)``; None asks for all.
    """
    wanted = where(sources, predicate)
    if collections is not None:
        wanted = wanted.where(F.col("collection_id").isin(collections))
    return chunks.join(wanted.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")


def draw_order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id")))


def capped(chunks: DataFrame, per_collection: int, seed: int = 0) -> DataFrame:
    """At most ``per_collection`` chunks of each collection, drawn by seed."""
    return weighted_mix(chunks, None, per_collection, seed)


def weighted_mix(chunks: DataFrame, weights: dict[int, float] | None, total: int, seed: int = 0) -> DataFrame:
    """``total`` chunks shared out among collections by weight, drawn by seed.

    A collection gets the whole part of its share, or all it has if that is
    less; collections without a weight get nothing.  Without weights each
    collection gets ``total``.
    """
    if total < 0 or (weights is not None and (not weights or min(weights.values()) <= 0)):
        raise QueryError("totals must not be negative and weights must be positive")
    order = Window.partitionBy("source_collection_id").orderBy(draw_order(seed), "chunk_id")
    quota = F.lit(total)
    rows = chunks
    if weights is not None:
        # Weights as they are written: 0.29 of 100 is 29, which binary fractions miss.
        exact = {collection: Fraction(str(weight)) for collection, weight in weights.items()}
        share = total / sum(exact.values())
        rows = chunks.where(F.col("source_collection_id").isin(list(weights)))
        quota = F.lit(0)
        for collection, weight in exact.items():
            quota = F.when(F.col("source_collection_id") == collection, int(weight * share)).otherwise(quota)
        total = max(int(w * share) for w in exact.values())
    # The constant bound lets Spark cut each group before the shuffle.
    ranked = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= total)
    return ranked.where(F.col("_rank") <= quota).drop("_rank")


def quotas(available: DataFrame, total: int) -> DataFrame:
    """``available(collection, rows, weight)`` -> (collection, quota): ``total`` rows, or all there are, shared out by weight.

    A collection with fewer rows than its share gives all it has, and the others share the rest by their
    weights (water filling); what whole numbers leave over goes to the largest remainders, the first collection
    where they are equal.  One row for each collection, weighed in one task.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("rows").cast("decimal(38,18)") / F.col("weight"), "collection")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        available.where("rows > 0 AND weight > 0")
        .withColumns({"rows": wide("rows"), "weight": wide("weight")})
        .withColumns({"_left": F.lit(total) - F.coalesce(F.sum("rows").over(before), F.lit(0)), "_weights": F.sum("weight").over(onward)})
        .withColumn("_all", F.col("rows") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    )
    # From the first collection that has more than its share, all have.
    rest = Window.partitionBy("_all")
    shared = filled.withColumns({"_rest": F.max("_left").over(rest), "_sum": F.sum("weight").over(rest)}).withColumns(
        {"_whole": F.floor(F.col("_rest") * F.col("weight") / F.col("_sum")), "_over": (F.col("_rest") * F.col("weight")) % F.col("_sum")}
    )
    spare = shared.withColumn("_spare", F.col("_rest") - F.sum("_whole").over(rest)).withColumn(
        "_place", F.row_number().over(Window.partitionBy("_all").orderBy(F.desc("_over"), "collection"))
    )
    quota = F.when(F.col("_all"), F.col("rows")).otherwise(F.col("_whole") + (F.col("_place") <= F.col("_spare")).cast("int"))
    return spare.select("collection", quota.cast("bigint").alias("quota"))


def sample(
    chunks: DataFrame,
    *,
    most: int | None = None,
    caps: dict[int, int] | None = None,
    strategy: Literal["stratified", "uniform", "none"] = "uniform",
    weights: dict[int, float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """At most ``caps[c]`` chunks of a collection and exactly ``most`` in all, if there are so many.

    ``uniform`` gives every collection the same, ``stratified`` in proportion to what it has within its
    cap, ``weights`` (instead of either; collections without one get nothing) by weight; chunks of a collection are drawn by seed.  ``none`` takes
    the first ones in the order of source and chunk id.  Only ids are ranked, in ranges, so a collection
    may hold most of the chunks.  Chunk ids are unique, as in the table.
    """
    if strategy not in ("stratified", "uniform", "none"):
        raise QueryError(f"unknown strategy: {strategy}")
    if (most is not None and most < 0) or any(n < 0 for n in (caps or {}).values()) or any(w <= 0 for w in (weights or {1: 1}).values()):
        raise QueryError("totals and caps must not be negative and weights must be positive")
    # A struct: the group of chunks without a collection is a group like any other.
    group = F.struct(F.col("source_collection_id").alias("id")).alias("collection")
    ids = chunks.select("chunk_id", "source_id", group, draw_order(seed).alias("_draw"))
    by = ["source_id", "chunk_id"] if strategy == "none" and weights is None else ["_draw", "chunk_id"]
    ranked = rank_in_group(ids, ["collection"], by, "place")
    cap = F.lit(None).cast("bigint")
    for collection, n in (caps or {}).items():
        cap = F.when(F.col("collection.id") == collection, F.lit(n)).otherwise(cap)
    capped_rows = ranked.where(cap.isNull() | (F.col("place") < cap))
    if most is None:
        chosen = capped_rows
        if weights is not None:
            raise QueryError("weights need a total")
    elif by[0] == "source_id":
        first = rank_in_group(capped_rows.select("chunk_id", "source_id", F.lit(0).alias("_all")), ["_all"], by, "first")
        chosen = first.where(F.col("first") < most)
    else:
        counts = capped_rows.groupBy("collection").agg(F.count(F.lit(1)).alias("rows"))
        weight = F.lit(1) if strategy == "uniform" else F.col("rows")
        if weights is not None:
            exact = {c: Fraction(str(w)) for c, w in weights.items()}
            scale = math.lcm(*(w.denominator for w in exact.values()))
            weight = F.lit(0)
            for collection, w in exact.items():
                weight = F.when(F.col("collection.id") == collection, F.lit(int(w * scale))).otherwise(weight)
        allowed = quotas(counts.withColumn("weight", weight), most)
        chosen = capped_rows.join(allowed, "collection").where(F.col("place") < F.col("quota"))
    return chunks.join(chosen.select("chunk_id"), "chunk_id", "left_semi")


def compare(chunks: DataFrame, column: str, left: str | None, right: str | None) -> DataFrame:
    """How often each value of a column occurs under either predicate, in one pass."""
    if column not in chunks.columns:
        raise QueryError(f"unknown column: {column}")
    sides = [F.coalesce(predicate_column(chunks, p), F.lit(False)) for p in (left, right)]
    marked = chunks.select(F.col(f"`{column}`").alias("value"), sides[0].alias("_left"), sides[1].alias("_right"))
    return (
        marked.where("_left OR _right")
        .groupBy("value")
        .agg(F.count_if("_left").alias("left_count"), F.count_if("_right").alias("right_count"))
    )


def split_statistics(rows: DataFrame, values: list[str]) -> DataFrame:
    """Per split: rows, and count, mean, least and largest of each value column."""
    aggregates = [
        f(name).alias(f"{label}_{name}")
        for name in values
        for label, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))
    ]
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *aggregates)


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, change) between two versions: added, removed, or changed in any column.

    A column that only one version has counts as NULL in the other, so a chunk changes by it where it has a value.
    A chunk that occurs several times in a version is compared by all its rows.
    """
    columns = sorted(({*old.columns} | {*new.columns}) - {"chunk_id"})

    def prints(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(f"`{n}`") if n in df.columns else F.lit(None) for n in columns]
        # An absent value goes in as two constants, whatever its column's type.
        tagged = [c for v in values for c in (v.isNull(), v)]
        row = F.xxhash64(*tagged).cast("decimal(38,0)")
        return df.groupBy("chunk_id").agg(F.struct(F.sum(row), F.count(F.lit(1))).alias(name))

    both = prints(old, "_old").join(prints(new, "_new"), "chunk_id", "full")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    )
    return both.select("chunk_id", change.alias("change")).where("change IS NOT NULL")
