"""Lineage of whole tables: from every chunk to its root and its source.

Chains are found by doubling: a row knows the next 1, 2, 4, ... ancestors, and
joining rows to the row of their last known ancestor doubles that.  Five joins
cover the 32 entries a chain may have, and only derived chunks that have not
reached a root take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.session import discard, materialize

# Fixed value: entries a chain may have, its own chunk included.
MAX_DEPTH = 32

_STATE = ["chunk_id", "path", "state", "root_source"]


def _first_steps(chunks: DataFrame) -> DataFrame:
    """(chunk_id, path, state, root_source) of derived chunks after one hop."""
    links = chunks.where("augmented_from IS NOT NULL").select(
        "chunk_id", F.col("augmented_from").alias("parent")
    )
    parents = chunks.select(
        F.col("chunk_id").alias("parent"),
        F.col("augmented_from").alias("_above"),
        F.col("source_id").alias("root_source"),
        F.lit(True).alias("_found"),
    )
    return links.join(parents, "parent", "left").select(
        "chunk_id",
        F.when(F.col("_found"), F.array("parent"))
        .otherwise(F.array().cast("array<string>"))
        .alias("path"),
        F.when(F.col("_found").isNull(), "broken")
        .when(F.col("_above").isNull(), "root")
        .otherwise("open")
        .alias("state"),
        "root_source",
    )


def _double(steps: DataFrame) -> DataFrame:
    onward = steps.select(
        F.col("chunk_id").alias("_end"),
        F.col("path").alias("_path"),
        F.col("state").alias("_state"),
        F.col("root_source").alias("_source"),
    )
    still = steps.where("state = 'open'").withColumn("_end", F.element_at("path", -1))
    longer = still.join(onward, "_end").select(
        "chunk_id",
        F.concat("path", "_path").alias("path"),
        F.col("_state").alias("state"),
        F.col("_source").alias("root_source"),
    )
    return steps.where("state <> 'open'").select(*_STATE).unionByName(longer)


def chains(chunks: DataFrame) -> DataFrame:
    """(chunk_id, entries, status, root_id, root_source) of every chunk.

    ``entries`` runs from the chunk to its root.  Status is ok, cycle, too_deep,
    broken_parent or null_source; a chain of exactly 32 entries is ok, a cycle
    of 32 is too_deep since the repetition would be entry 33.
    """
    nodes = chunks.select("chunk_id", "source_id", "augmented_from")
    steps = materialize(_first_steps(nodes), "lineage")
    known = 1
    while known < MAX_DEPTH and not steps.where("state = 'open'").isEmpty():
        before, steps = steps, materialize(_double(steps), "lineage")
        discard(before)
        known *= 2
    roots = nodes.where("augmented_from IS NULL").select(
        "chunk_id",
        F.array().cast("array<string>").alias("path"),
        F.lit("root").alias("state"),
        F.col("source_id").alias("root_source"),
    )
    entries = F.concat(F.array("chunk_id"), F.col("path"))
    every = roots.unionByName(steps).select("*", entries.alias("_all"))
    walked = F.slice("_all", 1, MAX_DEPTH)
    fits = F.size("_all") <= MAX_DEPTH
    status = (
        F.when(F.size(F.array_distinct(walked)) < F.size(walked), "cycle")
        .when((F.col("state") == "broken") & fits, "broken_parent")
        .when((F.col("state") != "root") | ~fits, "too_deep")
        .when(F.col("root_source").isNull(), "null_source")
        .otherwise("ok")
    )
    return every.select("chunk_id", walked.alias("entries"), status.alias("status"), "root_source").select(
        "chunk_id",
        "entries",
        "status",
        F.when(F.col("status").isin("ok", "null_source"), F.element_at("entries", -1)).alias("root_id"),
        F.when(F.col("status") == "ok", F.col("root_source")).alias("root_source"),
    )


def chain_entries(chained: DataFrame) -> DataFrame:
    """One row per (chunk, depth), depth counted from 1 at the chunk itself."""
    return chained.where("status = 'ok'").select(
        "chunk_id", F.posexplode("entries").alias("_pos", "entry_id")
    ).select("chunk_id", (F.col("_pos") + 1).alias("depth"), "entry_id")


def descendants(chained: DataFrame) -> DataFrame:
    """(chunk_id, depth, derived_id): what was made from each chunk, however far down."""
    return (
        chain_entries(chained)
        .where("depth > 1")
        .select(F.col("entry_id").alias("chunk_id"), (F.col("depth") - 1).alias("depth"), F.col("chunk_id").alias("derived_id"))
    )


def broken_parents(chunks: DataFrame) -> DataFrame:
    """Chunks whose parent id names no chunk."""
    parents = chunks.select(F.col("chunk_id").alias("augmented_from"))
    return chunks.where("augmented_from IS NOT NULL").join(parents, "augmented_from", "left_anti")


def resolve(chained: DataFrame, sources: DataFrame, variants: DataFrame) -> DataFrame:
    """Chains with their source (required) and canonical variant (optional);
    status source_missing where the source does not exist."""
    canonical = (
        variants.where("is_canonical")
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.min("id").alias("variant_id"))
    )
    # One row per source, written first: many chains may share a source, and
    # only a join of two plain scans is split when it is skewed.
    known = materialize(
        sources.select("id", F.lit(True).alias("_found"))
        .join(canonical, "id", "full")
        .select(F.col("id").alias("root_source"), "variant_id", "_found"),
        "sources",
    )
    return chained.join(known, "root_source", "left").select(
        "chunk_id",
        "entries",
        F.when((F.col("status") == "ok") & F.col("_found").isNull(), "source_missing")
        .otherwise(F.col("status"))
        .alias("status"),
        "root_id",
        F.col("root_source").alias("source_id"),
        "variant_id",
    )
