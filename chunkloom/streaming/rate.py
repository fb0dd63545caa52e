"""Sliding call windows: load profile in batch, exact limiter on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Window length and calls allowed in it.
WINDOW_SECONDS = 60
CALLS_PER_WINDOW = 60


def call_load(
    calls: DataFrame,
    key: str,
    window_seconds: int = WINDOW_SECONDS,
    limit: int = CALLS_PER_WINDOW,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Calls of each key in the window that ends with each call.

    A call exactly one window old no longer counts.  The time line of a key is
    cut into slices; each slice also gets copies of the calls in the window
    before it, so a busy key is spread over its slices and counts stay exact.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = window_seconds * 1_000_000
    span = (slice_seconds or 10 * window_seconds) * 1_000_000
    timed = calls.withColumn("_us", micros).withColumn("_slice", F.floor(F.col("_us") / span))
    last = F.floor((F.col("_us") + (width - 1)) / span)
    placed = timed.withColumn("_part", F.explode(F.sequence("_slice", last)))
    window = (
        Window.partitionBy(key, "_part").orderBy("_us").rangeBetween(-(width - 1), Window.currentRow)
    )
    return (
        placed.withColumn("in_window", F.count(F.lit(1)).over(window))
        .where("_part = _slice")
        .withColumn("over_limit", F.col("in_window") > limit)
        .drop("_us", "_slice", "_part")
    )


def stream_limiter(
    calls: DataFrame, window_seconds: int = WINDOW_SECONDS, limit: int = CALLS_PER_WINDOW
) -> DataFrame:
    """Accept or reject ``calls(caller, call_id, ts)`` in order of time.

    A call is rejected when ``limit`` accepted ones lie less than one window
    back; rejected calls do not count.  The state per caller is the accepted
    times still in the window: at most ``limit`` numbers.
    """
    width = window_seconds * 1_000_000

    def decide(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "call_id"])
        verdicts = []
        for call_id, us in rows[["call_id", "us"]].itertuples(index=False):
            while accepted and us - accepted[0] >= width:
                accepted.pop(0)
            ok = len(accepted) < limit
            if ok:
                accepted.append(us)
            verdicts.append((key[0], call_id, ok))
        state.update((accepted,))
        yield pd.DataFrame(verdicts, columns=["caller", "call_id", "accepted"])

    return (
        calls.select("caller", "call_id", F.unix_micros("ts").alias("us"))
        .groupBy("caller")
        .applyInPandasWithState(
            decide,
            "caller bigint, call_id bigint, accepted boolean",
            "accepted array<bigint>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
