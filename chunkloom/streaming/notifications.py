"""Asset notifications and bounded subscriber queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.plans.recipes import source_key_column
from chunkloom.schema import CHUNKS_ASSET
from chunkloom.streaming.runs import ASSET_EVENT

# Fixed value: events a subscriber's queue holds.
QUEUE_SIZE = 100


def asset_notifications(events: DataFrame, runs: DataFrame) -> DataFrame:
    """One notification per routable asset event, for the owner of its run.

    A chunks event tells source and count (0 if not given), any other asset its
    key.  Events of unknown or ownerless runs, and events whose partition key
    is missing or malformed, are dropped.  Stateless: serves streams, too.
    """
    owners = runs.where("triggered_by IS NOT NULL").select(
        "run_id", F.col("triggered_by").alias("user_id")
    )
    chunks = F.coalesce("asset_key", F.lit("")) == CHUNKS_ASSET
    usable = F.coalesce("partition_key", F.lit("")) != ""
    source = F.when(chunks & usable, source_key_column(F.col("partition_key")))
    count = F.coalesce(
        F.get_json_object("metadata", "$.chunk_count").try_cast("bigint"), F.lit(0)
    )
    return (
        events.where(F.col("event_type") == ASSET_EVENT)
        .join(owners, "run_id")
        .withColumn("source_id", source)
        .where(usable & (~chunks | F.col("source_id").isNotNull()))
        .select(
            "event_id",
            "ts",
            "user_id",
            F.when(chunks, "chunks.added").otherwise("asset.materialized").alias("type"),
            "source_id",
            F.when(chunks, count).alias("count"),
            F.when(~chunks, F.col("asset_key")).alias("asset_key"),
            F.when(~chunks, F.col("partition_key")).alias("partition_key"),
        )
    )


def keep_last(events: DataFrame, key: str, n: int = QUEUE_SIZE) -> DataFrame:
    """The newest ``n`` events of each key.

    The rank limit is applied in every task before the shuffle, so a busy key
    sends at most n rows per task.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
    )
