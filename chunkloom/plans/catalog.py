"""Catalog operations on sources, variants, recipes, data sets and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.plans.skew import join_salted

# Listing orders.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    # (column, descending with NULLs last)
    "collections": [("id", False)],
    "sources": [("id", False)],
    "operators": [("id", False)],
    "recipes": [("created_at", True), ("id", True)],
    "datasets": [("materialized_at", True), ("id", True)],
    "runs": [("started_at", True), ("id", True)],
}


def _behind(kind: str, after: tuple) -> Column:
    """Rows behind the given values of a catalog's order columns; NULL values come last where the order descends."""
    found, same = F.lit(False), F.lit(True)
    for (name, down), value in zip(ORDERS[kind], after, strict=True):
        column = F.col(name)
        if down:
            further = F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()
        else:
            further = column.isNotNull() if value is None else column > F.lit(value)
        found, same = found | (same & F.coalesce(further, F.lit(False))), same & column.eqNullSafe(F.lit(value))
    return found


def listing(
    df: DataFrame, kind: str, limit: int, offset: int = 0, status: str | None = None, after: tuple | None = None
) -> DataFrame:
    """One page of a catalog in its order, optionally of one status.

    An ``offset`` passes over rows that it still has to order; ``after``, the order columns of the last row seen,
    starts behind that row by a filter instead.
    """
    rows = df if status is None else df.where(F.col("status") == F.lit(status))
    if after is not None:
        if len(after) != len(ORDERS[kind]):
            raise ValueError(f"after needs a value for each of {', '.join(c for c, _ in ORDERS[kind])}")
        rows = rows.where(_behind(kind, after))
    keys = [F.desc_nulls_last(c) if down else F.asc(c) for c, down in ORDERS[kind]]
    return rows.orderBy(*keys).offset(offset).limit(limit)


def visible_sources(sources: DataFrame, collections: DataFrame, user: Column | int) -> DataFrame:
    """Sources in a collection of the user, and sources without collection.

    A collection id that names no collection has no owner: not visible.
    """
    own = collections.select(F.col("id").alias("_cid"), F.col("owner_id").alias("_owner"))
    return (
        sources.join(own, F.col("collection_id") == F.col("_cid"), "left")
        .where((F.col("_owner") == user) | F.col("collection_id").isNull())
        .drop("_cid", "_owner")
    )


def visible_variants(
    variants: DataFrame, sources: DataFrame, collections: DataFrame, user: Column | int
) -> DataFrame:
    """Document variants whose source the user may see."""
    seen = visible_sources(sources, collections, user).select(F.col("id").alias("source_id"))
    return variants.join(seen, "source_id", "left_semi")


def active_operators(operators: DataFrame, category: str | None = None) -> DataFrame:
    """Operators not switched off; NULL counts as active."""
    rows = operators.where("is_active IS NOT FALSE")
    return (rows if category is None else rows.where(F.col("category") == category)).orderBy("id")


def missing_ids(requested: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested ids that do not exist, each once."""
    return requested.select("id").distinct().join(sources.select("id"), "id", "left_anti")


def set_canonical(variants: DataFrame, extractor: str) -> DataFrame:
    """For every source with a variant of ``extractor``, its latest one (largest
    id) becomes the only canonical variant; other sources keep theirs."""
    chosen = variants.groupBy("source_id").agg(
        F.max(F.when(F.col("extractor_name") == extractor, F.col("id"))).alias("_chosen"),
        F.count(F.lit(1)).alias("n"),
    )
    return join_salted(variants, chosen, "source_id", F.col("id"), how="left").select(
        *[
            F.when(F.col("_chosen").isNull(), F.col(c)).otherwise(F.col("id") == F.col("_chosen")).alias(c)
            if c == "is_canonical"
            else F.col(c)
            for c in variants.columns
        ]
    )


def insert_variants(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append variants; one of a known (source, extractor, config) is ignored.

    The first variant of a source without a canonical one becomes canonical.
    """
    key = ["source_id", "extractor_name", "config_hash"]
    rest = [c for c in new.columns if c not in key and c != "id"]
    first = new.groupBy(*key).agg(F.min(F.struct("id", *rest)).alias("_row"))
    added = first.select(*key, "_row.*").join(existing.select(*key), key, "left_anti")
    taken = existing.where("is_canonical").select("source_id")
    elected = (
        added.join(taken, "source_id", "left_anti")
        .groupBy("source_id")
        .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("n"))
    )
    rows = join_salted(
        added.drop("is_canonical"), elected, "source_id", F.col("id"), how="left"
    ).withColumn("is_canonical", F.coalesce(F.col("id") == F.col("_first"), F.lit(False)))
    return existing.unionByName(rows.select(*existing.columns))


def next_versions(recipes: DataFrame, datasets: DataFrame) -> DataFrame:
    """(recipe_id, version_tag, partition_key) of every recipe's next version;
    all earlier data sets count, failed ones too."""
    made = datasets.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("_n"))
    n = (F.coalesce("_n", F.lit(0)) + 1).cast("string")
    rid = F.col("recipe_id")
    return (
        recipes.select(F.col("id").alias("recipe_id"))
        .join(made, "recipe_id", "left")
        .select(
            "recipe_id",
            F.concat(F.lit("v"), n).alias("version_tag"),
            F.concat(F.lit("ds_"), rid.cast("string"), F.lit("_v"), n).alias("partition_key"),
        )
    )


def new_datasets(recipes: DataFrame, datasets: DataFrame, first_id: int) -> DataFrame:
    """Pending rows for every recipe's next version, with its frozen definition.

    Data set ids are ``first_id + recipe id``: dense enough, and known without
    counting rows across tasks.
    """
    did = (F.col("recipe_id") + first_id).cast("bigint")
    return (
        next_versions(recipes, datasets)
        .join(recipes.select(F.col("id").alias("recipe_id"), "definition"), "recipe_id")
        .select(
            did.alias("id"),
            "recipe_id",
            "version_tag",
            F.concat(F.lit("s3://datasets/"), did.cast("string"), F.lit("_"), "version_tag").alias("hf_repo_uri"),
            F.col("definition").alias("recipe_snapshot"),
            F.lit("pending").alias("status"),
        )
    )


def locked_recipes(recipes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Recipes that may not change: some data set of theirs has not failed."""
    alive = datasets.where("status <> 'failed'").select(F.col("recipe_id").alias("id"))
    return recipes.join(alive, "id", "left_semi")


def update_recipes(recipes: DataFrame, datasets: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(id, definition)`` to unlocked recipes; ``outcome`` tells
    what happened: updated, locked or unchanged."""
    alive = (
        datasets.where("status <> 'failed'")
        .select(F.col("recipe_id").alias("id"))
        .distinct()
        .withColumn("_locked", F.lit(True))
    )
    new = changes.select("id", F.col("definition").alias("_new"), F.lit(True).alias("_asked"))
    joined = recipes.join(new, "id", "left").join(alive, "id", "left")
    apply = F.col("_asked").isNotNull() & F.col("_locked").isNull()
    return joined.select(
        *[
            F.when(apply, F.col("_new")).otherwise(F.col(c)).alias(c) if c == "definition" else F.col(c)
            for c in recipes.columns
        ],
        F.when(apply, "updated").when(F.col("_asked"), "locked").otherwise("unchanged").alias("outcome"),
    )


def mark_done(datasets: DataFrame, finished: DataFrame, now: Column | None = None) -> DataFrame:
    """Set pending data sets that finished to done with their counts; a data
    set that is done already stays as it is."""
    result = finished.select(
        F.col("dataset_id").alias("id"),
        F.col("sample_count").alias("_samples"),
        F.col("size_bytes").alias("_bytes"),
        F.lit(True).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull() & (F.col("status") == "pending")
    new = {
        "status": F.lit("done"),
        "sample_count": F.col("_samples"),
        "size_bytes": F.col("_bytes"),
        "materialized_at": F.current_timestamp() if now is None else now,
    }
    return datasets.join(result, "id", "left").select(
        *[
            F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in datasets.columns
        ]
    )


def mark_failed(datasets: DataFrame, failed: DataFrame) -> DataFrame:
    """Tombstone failed attempts: they keep their version."""
    bad = failed.select(F.col("dataset_id").alias("id"), F.lit(True).alias("_hit"))
    return datasets.join(bad, "id", "left").select(
        *[
            F.when(F.col("_hit"), F.lit("failed")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
            for c in datasets.columns
        ]
    )


# USD per million input and output tokens.
PRICES: dict[str, tuple[float, float]] = {"claude-3-haiku-20240307": (0.25, 1.25)}


def call_cost(
    model: Column, input_tokens: Column, output_tokens: Column,
    prices: dict[str, tuple[float, float]] = PRICES,
) -> Column:
    """USD of one model call; an unknown model costs 0."""
    cost = F.lit(0.0)
    for name, (price_in, price_out) in prices.items():
        cost = F.when(
            model == name, (input_tokens * price_in + output_tokens * price_out) / 1_000_000
        ).otherwise(cost)
    return cost


def run_requests(requested: DataFrame, sources: DataFrame, asset: str) -> DataFrame:
    """Partition keys of a backfill: the sources asked for that exist."""
    return requested.select("id").distinct().join(sources.select("id"), "id", "left_semi").select(
        F.lit(asset).alias("asset"),
        F.col("id").alias("source_id"),
        F.concat(F.lit("src_"), F.col("id").cast("string")).alias("partition_key"),
    )
