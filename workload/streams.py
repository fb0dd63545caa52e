"""Run and asset events: batch forms, and the same as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.session import scratch_path
from chunkloom.sources.chunk_table import ChunkTable
from chunkloom.streaming import notifications, rate, runs
from chunkloom.streaming.ingest import start_chunking
from workload import tables
from workload.registry import CHUNKS, query

EVENTS = """ev AS (SELECT event_id, ts, user_id AS run_id,
    CASE event_type WHEN 'signup' THEN 'RUN_START' WHEN 'purchase' THEN 'RUN_SUCCESS'
      WHEN 'error' THEN 'RUN_FAILURE' ELSE 'ASSET_MATERIALIZATION' END AS event_type,
    CASE event_type WHEN 'click' THEN 'chunks' WHEN 'view' THEN 'extract_mineru' END AS asset_key,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN 'src_x'
      ELSE 'src_' || event_id END AS partition_key,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n
  FROM events),
runs AS (SELECT DISTINCT run_id, CASE WHEN run_id % 7 <> 0 THEN run_id % 4 END AS triggered_by
         FROM ev WHERE run_id % 10 <> 0),
moves AS (SELECT *, CASE event_type WHEN 'RUN_START' THEN 'running' WHEN 'RUN_SUCCESS' THEN 'success'
                    WHEN 'RUN_FAILURE' THEN 'failure' END AS status
          FROM ev WHERE event_type <> 'ASSET_MATERIALIZATION')"""

STATUS = f"""WITH {EVENTS}, last AS (
  SELECT run_id, status FROM moves QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1),
times AS (SELECT run_id, max(CASE WHEN status = 'running' THEN epoch_us(ts) END) AS s,
                 max(CASE WHEN status <> 'running' THEN epoch_us(ts) END) AS e FROM moves GROUP BY run_id)"""

CHANGES = f"""WITH {EVENTS}, steps AS (SELECT event_id, run_id,
    coalesce(lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id), 'pending') AS "from",
    status AS "to" FROM moves)
SELECT event_id, run_id, "from", "to" FROM steps WHERE "from" <> "to" """


def _micros(name: str, alias: str):
    return F.unix_micros(name).cast("string").alias(alias)


@query(f"""{STATUS}
SELECT r.run_id, coalesce(l.status, 'pending') AS status, CAST(t.s AS VARCHAR) AS started_us,
       CAST(t.e AS VARCHAR) AS ended_us
FROM runs r LEFT JOIN last l ON l.run_id = r.run_id LEFT JOIN times t ON t.run_id = r.run_id""")
def run_status_fold(spark: SparkSession, sf: str) -> DataFrame:
    done = runs.apply_status(tables.runs(spark, sf), tables.events(spark, sf))
    return done.select("run_id", "status", _micros("started_at", "started_us"), _micros("ended_at", "ended_us"))


@query(CHANGES)
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return runs.status_changes(tables.events(spark, sf)).drop("ts")


@query(f"""WITH {EVENTS}
SELECT event_id, run_id IN (SELECT run_id FROM runs) AS processed,
       CASE WHEN run_id NOT IN (SELECT run_id FROM runs) THEN 'unknown_run' END AS reason FROM ev""")
def events_processed(spark: SparkSession, sf: str) -> DataFrame:
    return runs.processed(tables.events(spark, sf), tables.runs(spark, sf)).select(
        "event_id", "processed", "reason"
    )


NOTIFIED = f"""WITH {EVENTS}
SELECT e.event_id, r.triggered_by AS user_id,
       CASE WHEN asset_key = 'chunks' THEN 'chunks.added' ELSE 'asset.materialized' END AS type,
       CASE WHEN asset_key = 'chunks' THEN substr(partition_key, 5) END AS source_id,
       CASE WHEN asset_key = 'chunks' THEN CAST(n AS VARCHAR) END AS count,
       CASE WHEN asset_key <> 'chunks' THEN partition_key END AS partition_key
FROM ev e JOIN runs r ON r.run_id = e.run_id
WHERE event_type = 'ASSET_MATERIALIZATION' AND triggered_by IS NOT NULL AND partition_key IS NOT NULL
  AND (asset_key <> 'chunks' OR partition_key <> 'src_x')"""


def _notification_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "user_id", "type", F.col("source_id").cast("string"),
        F.col("count").cast("string"), "partition_key",
    )


@query(NOTIFIED)
def asset_notifications(spark: SparkSession, sf: str) -> DataFrame:
    return _notification_columns(
        notifications.asset_notifications(tables.events(spark, sf), tables.runs(spark, sf))
    )


@query("""SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""")
def last_100(spark: SparkSession, sf: str) -> DataFrame:
    kept = notifications.keep_last(tables.table(spark, sf, "events"), "event_type")
    return kept.select("event_id", "event_type")


@query("""SELECT event_id, n AS in_window, n > 3 AS over_limit FROM (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW) AS n FROM events)""")
def call_window(spark: SparkSession, sf: str) -> DataFrame:
    """Calls per user in the last six hours, flagged above three."""
    load = rate.call_load(
        tables.table(spark, sf, "events"), "user_id", window_seconds=21600, limit=3, slice_seconds=86400
    )
    return load.select("event_id", "in_window", "over_limit")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream.  The files of a table have no order, so they make one batch."""
    return tables.as_run_events(tables.stream(spark, sf, "events"))


def _drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there; its output as a table."""
    spark = stream.sparkSession
    out, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        query_ = writer.format("parquet").option("path", out).start()
    else:
        query_ = (
            writer.outputMode(mode)
            .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
            .start()
        )
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"""{STATUS}
SELECT l.run_id, l.status, CAST(t.s AS VARCHAR) AS started_us, CAST(t.e AS VARCHAR) AS ended_us
FROM last l JOIN times t ON t.run_id = l.run_id""")
def stream_status_fold(spark: SparkSession, sf: str) -> DataFrame:
    folded = _drain(runs.fold_status(_event_stream(spark, sf)), "status", "complete")
    return folded.select(
        "run_id", "status", _micros("started_at", "started_us"), _micros("ended_at", "ended_us")
    )


@query(CHANGES)
def stream_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _drain(runs.stream_status_changes(_event_stream(spark, sf)), "changes").drop("ts")


@query(NOTIFIED)
def stream_notifications(spark: SparkSession, sf: str) -> DataFrame:
    stream = notifications.asset_notifications(_event_stream(spark, sf), tables.runs(spark, sf))
    return _notification_columns(_drain(stream, "notifications"))


@query("""WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS q,
         CAST(NULL AS BIGINT) AS event_id, false AS accepted FROM events
  UNION ALL
  SELECT user_id, n, CASE WHEN len(f) < 3 THEN list_append(f, us) ELSE f END, event_id, len(f) < 3
  FROM (SELECT c.user_id, c.n, c.us, c.event_id,
               list_filter(w.q, lambda x: c.us - x < 21600000000) AS f
        FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1))
SELECT user_id AS caller, event_id AS call_id, accepted FROM w WHERE n > 0""")
def stream_limiter(spark: SparkSession, sf: str) -> DataFrame:
    """Three calls in six hours per user; rejected calls do not count."""
    calls = _event_stream(spark, sf).select(
        F.col("run_id").alias("caller"), F.col("event_id").alias("call_id"), "ts"
    )
    return _drain(rate.stream_limiter(calls, window_seconds=21600, limit=3), "limiter")


@query(f"WITH {CHUNKS} SELECT chunk_id, token_count, md5(text) AS text_md5 FROM chunks")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arriving as a stream, chunked into the table."""
    arriving = tables.stream(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"),
        F.expr("cast(substr(source, 4) as bigint)").alias("source_collection_id"),
        "text",
    )
    table = ChunkTable(spark, scratch_path(spark, "stream_ingest"), buckets=4)
    start_chunking(arriving, table, scratch_path(spark, "stream_ingest-progress")).awaitTermination()
    return table.read().select(
        "chunk_id", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )
