import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chunkloom.session import scratch_path
from chunkloom.sources.chunk_table import ChunkTable
from chunkloom.streaming import ingest, notifications, rate, runs

EVENT = "event_id bigint, ts timestamp, run_id bigint, event_type string, asset_key string, partition_key string, metadata string"
START = datetime(2024, 1, 1)


def event(i, run, kind, seconds=None, asset=None, key=None, metadata="{}"):
    return (i, START + timedelta(seconds=i if seconds is None else seconds), run, kind, asset, key, metadata)


def history(n=400, n_runs=5, seed=1):
    rng = random.Random(seed)
    kinds = ["RUN_START", "RUN_SUCCESS", "RUN_FAILURE", "RUN_CANCELED", "ASSET_MATERIALIZATION"]
    return [event(i, 0 if rng.random() < 0.5 else rng.randrange(n_runs), rng.choice(kinds), rng.randrange(200)) for i in range(n)]


def fold(events):
    state, changes = {}, []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        status = runs.STATUS_OF.get(e[3])
        if status is None:
            continue
        now = state.setdefault(e[2], {"status": "pending", "start": None, "end": None})
        if now["status"] != status:
            changes.append((e[0], e[2], now["status"], status))
        now["status"] = status
        now["start" if status == "running" else "end"] = e[1]
    return state, sorted(changes)


def test_fold_and_changes_equal_a_loop(spark):
    events = history()
    df = spark.createDataFrame(random.Random(0).sample(events, len(events)), EVENT)
    state, changes = fold(events)
    got = {r.run_id: {"status": r.status, "start": r.started_at, "end": r.ended_at} for r in runs.fold_status(df).collect()}
    assert got == state
    assert sorted((r.event_id, r.run_id, r["from"], r["to"]) for r in runs.status_changes(df).collect()) == changes


def test_later_start_keeps_the_end(spark):
    df = spark.createDataFrame([event(1, 1, "RUN_START"), event(2, 1, "RUN_CANCELED"), event(3, 1, "RUN_START")], EVENT)
    row = runs.fold_status(df).first()
    assert (row.status, row.started_at, row.ended_at) == ("running", START + timedelta(seconds=3), START + timedelta(seconds=2))


def stream_of(spark, rows, schema, folder, batches):
    """Files written one after another, one per micro-batch."""
    for i in range(batches):
        spark.createDataFrame(rows[i::batches] if batches == 1 else rows[len(rows) * i // batches : len(rows) * (i + 1) // batches], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, folder):
    out = f"{folder}-out"
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out).collect()


def test_stream_changes_across_batches(spark, folder):
    events = [event(i, e[2], e[3]) for i, e in enumerate(history(120))]
    stream = stream_of(spark, events, EVENT, folder, 3)
    got = sorted((r.event_id, r.run_id, r["from"], r["to"]) for r in drain(runs.stream_status_changes(stream), folder))
    assert got == fold(events)[1]


def test_processed_and_apply(spark):
    known = spark.createDataFrame([(1, "pending", None, None), (2, "pending", None, None)], "run_id bigint, status string, started_at timestamp, ended_at timestamp")
    df = spark.createDataFrame([event(1, 1, "RUN_START"), event(2, 9, "RUN_START")], EVENT)
    assert sorted((r.event_id, r.processed, r.reason) for r in runs.processed(df, known).collect()) == [(1, True, None), (2, False, "unknown_run")]
    assert {r.run_id: r.status for r in runs.apply_status(known, df).collect()} == {1: "running", 2: "pending"}


def test_notifications(spark):
    owners = spark.createDataFrame([(1, 7), (2, None)], "run_id bigint, triggered_by bigint")
    kind = "ASSET_MATERIALIZATION"
    rows = [event(1, 1, kind, None, "chunks", "src_5", '{"chunk_count": 3}'), event(2, 1, kind, None, "chunks", "src_5"),
            event(3, 1, kind, None, "chunks", "src_x"), event(4, 1, kind, None, "chunks", None), event(5, 1, kind, None, "extract_mineru", "anything"),
            event(6, 1, kind, None, "extract_mineru", ""), event(7, 2, kind, None, "chunks", "src_5"), event(8, 9, kind, None, "chunks", "src_5"),
            event(9, 1, "RUN_START", None, "chunks", "src_5"), event(10, 1, kind, None, None, "k")]
    got = notifications.asset_notifications(spark.createDataFrame(rows, EVENT), owners).orderBy("event_id").collect()
    assert [(r.event_id, r.type, r.source_id, r["count"], r.asset_key) for r in got] == [
        (1, "chunks.added", 5, 3, None), (2, "chunks.added", 5, 0, None), (5, "asset.materialized", None, None, "extract_mineru"), (10, "asset.materialized", None, None, None)]
    assert all(r.user_id == 7 for r in got)


def test_keep_last(spark):
    rows = [event(i, i % 2 if i < 50 else 0, "x", i // 3) for i in range(300)]
    df = spark.createDataFrame(rows, EVENT)
    kept = notifications.keep_last(df, "run_id")
    for run in (0, 1):
        own = sorted((r for r in rows if r[2] == run), key=lambda r: (r[1], r[0]))[-100:]
        assert {r.event_id for r in kept.where(F.col("run_id") == run).collect()} == {r[0] for r in own}
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("slice_seconds", [60, 97, 100000])
def test_call_load_equals_brute_force(spark, slice_seconds):
    rng = random.Random(2)
    calls = [(i, rng.randrange(2), START + timedelta(seconds=rng.randrange(600), microseconds=rng.choice([0, 0, 1, 999999]))) for i in range(300)]
    calls += [(1000, 0, START + timedelta(seconds=1000)), (1001, 0, START + timedelta(seconds=1060)), (1002, 0, START + timedelta(seconds=1059, microseconds=999999))]
    df = spark.createDataFrame(calls, "call_id bigint, caller bigint, ts timestamp")
    got = {r.call_id: (r.in_window, r.over_limit) for r in rate.call_load(df, "caller", limit=15, slice_seconds=slice_seconds).collect()}
    assert len(got) == len(calls)
    for i, caller, ts in calls:
        n = sum(c == caller and timedelta(0) <= ts - t < timedelta(seconds=60) for _, c, t in calls)
        assert got[i] == (n, n > 15)


def test_stream_limiter_equals_a_queue(spark, folder):
    rng = random.Random(3)
    times = sorted(rng.randrange(300) for _ in range(150))
    calls = [(rng.randrange(2), i, START + timedelta(seconds=t)) for i, t in enumerate(times)]
    stream = stream_of(spark, calls, "caller bigint, call_id bigint, ts timestamp", folder, 3)
    got = {r.call_id: r.accepted for r in drain(rate.stream_limiter(stream, limit=10), folder)}
    queues, want = {0: deque(), 1: deque()}, {}
    for caller, call, ts in calls:
        q = queues[caller]
        while q and ts - q[0] >= timedelta(seconds=60):
            q.popleft()
        want[call] = len(q) < 10
        if want[call]:
            q.append(ts)
    assert got == want and set(want.values()) == {True, False}


def test_documents_stream_and_backfill_are_repeatable(spark, folder):
    schema = "source_id bigint, source_collection_id bigint, text string"
    rows = [(i, 1, f"a b c {i}") for i in range(8)]
    table = ChunkTable(spark, f"{folder}-table", buckets=2)
    arriving = stream_of(spark, rows, schema, folder, 2)
    ingest.start_chunking(arriving, table, f"{folder}-one").awaitTermination()
    first = sorted((r.chunk_id, r.text) for r in table.read().collect())
    assert len(first) == 8
    again = spark.readStream.schema(schema).parquet(folder)
    ingest.start_chunking(again, table, scratch_path(spark, "two")).awaitTermination()
    ingest.backfill(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (3,), (77,)], "id bigint"), table)
    assert sorted((r.chunk_id, r.text) for r in table.read().collect()) == first


def test_stream_queries_read_tables_of_several_files(spark, folder):
    from workload import streams, tables

    source = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    queries = (streams.stream_ingest, streams.stream_status_fold, streams.stream_status_changes, streams.stream_notifications, streams.stream_limiter)
    for query in queries:
        got, want = (sorted(map(str, query(spark, sf).collect())) for sf in (folder, source))
        assert got == want and want, query.__name__
    assert streams.stream_ingest(spark, folder).count() == tables.chunks(spark, folder).count()
