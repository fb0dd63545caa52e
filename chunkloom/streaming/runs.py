"""Run status from lifecycle events.

Events: (event_id, ts, run_id, event_type, ...), ordered by (ts, event_id), so
a replay gives the same answer whatever the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkloom.plans.ranking import previous_in_group

# Lifecycle events and the status they lead to.
STATUS_OF = {
    "RUN_START": "running",
    "RUN_SUCCESS": "success",
    "RUN_FAILURE": "failure",
    "RUN_CANCELED": "failure",
}
ASSET_EVENT = "ASSET_MATERIALIZATION"
INITIAL_STATUS = "pending"


def status_column(event_type: Column) -> Column:
    expr = F.lit(None).cast("string")
    for event, status in STATUS_OF.items():
        expr = F.when(event_type == event, status).otherwise(expr)
    return expr


def fold_status(events: DataFrame) -> DataFrame:
    """(run_id, status, started_at, ended_at) after all events seen.

    Only associative aggregates, so a run with any number of events is combined
    before the shuffle; on a stream the same plan keeps one small row per run.
    A later start does not clear the end.
    """
    at = F.struct("ts", "event_id")
    moves = events.withColumn("_status", status_column(F.col("event_type"))).where(
        "_status IS NOT NULL"
    )
    started = F.when(F.col("_status") == "running", at)
    ended = F.when(F.col("_status") != "running", at)
    return moves.groupBy("run_id").agg(
        F.max(F.struct(at.alias("at"), F.col("_status").alias("status")))["status"].alias("status"),
        F.max(started)["ts"].alias("started_at"),
        F.max(ended)["ts"].alias("ended_at"),
    )


def apply_status(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with their status and times brought up to date."""
    new = fold_status(events).select(
        "run_id",
        F.col("status").alias("_status"),
        F.col("started_at").alias("_started"),
        F.col("ended_at").alias("_ended"),
    )
    fresh = {"status": "_status", "started_at": "_started", "ended_at": "_ended"}
    return runs.join(new, "run_id", "left").select(
        *[F.coalesce(fresh[c], c).alias(c) if c in fresh else F.col(c) for c in runs.columns]
    )


def processed(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Each event with ``processed`` and, for an unknown run, the reason.
    Works with streaming events and static runs."""
    known = runs.select("run_id", F.lit(True).alias("_known"))
    return (
        events.join(known, "run_id", "left")
        .withColumn("processed", F.col("_known").isNotNull())
        .withColumn("reason", F.when(F.col("_known").isNull(), "unknown_run"))
        .drop("_known")
    )


def status_changes(events: DataFrame) -> DataFrame:
    """Batch: one row per event that changed its run's status.

    Runs may be long: the previous status is found range by range, never by
    one window over a whole run.
    """
    moves = events.withColumn("to", status_column(F.col("event_type"))).where("to IS NOT NULL")
    ordered = previous_in_group(
        moves.select("event_id", "ts", "run_id", "to"), "run_id", ["ts", "event_id"], "to", "_previous"
    )
    return ordered.withColumn("from", F.coalesce("_previous", F.lit(INITIAL_STATUS))).where(
        "from <> to"
    ).select("event_id", "ts", "run_id", "from", "to")


def stream_status_changes(events: DataFrame) -> DataFrame:
    """Streaming form of ``status_changes``: events count in the order in which they
    arrive, those of one micro-batch by (ts, event_id), and none is passed over.
    A late event therefore changes the status when it comes; without late events the
    changes are those of the batch form.  The state per run is its status.  The source's
    per-trigger limit bounds what one micro-batch holds of a run."""
    moves = events.withColumn("to", status_column(F.col("event_type"))).where("to IS NOT NULL")
    out = "event_id bigint, ts timestamp, run_id bigint, `from` string, `to` string"

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else INITIAL_STATUS
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        found = []
        for event_id, ts, new in rows[["event_id", "ts", "to"]].itertuples(index=False):
            if new != status:
                found.append((event_id, ts, key[0], status, new))
                status = new
        state.update((status,))
        yield pd.DataFrame(found, columns=["event_id", "ts", "run_id", "from", "to"])

    return (
        moves.select("run_id", "event_id", "ts", "to")
        .groupBy("run_id")
        .applyInPandasWithState(
            advance,
            out,
            "status string",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
