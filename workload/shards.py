"""Chunks written as sized shards of JSON lines in three splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.session import scratch_path
from chunkloom.sources import shards
from workload import tables
from workload.recipes import _bucket_sql
from workload.registry import CHUNKS, query

SHARD_BYTES = 40_000
_PLACED = f"""{CHUNKS},
s AS (SELECT chunk_id, text, {_bucket_sql("chunk_id")} AS b, strlen(CAST(json_object('chunk_id', chunk_id, 'text', text) AS VARCHAR)) + 1 AS bytes FROM chunks),
n AS (SELECT *, CASE WHEN b < 10 THEN 'validation' WHEN b < 15 THEN 'test' ELSE 'train' END AS split FROM s),
p AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY split ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             // {SHARD_BYTES} AS shard FROM n)"""


def written(spark: SparkSession, sf: str) -> str:
    rows = tables.chunks(spark, sf).select("chunk_id", "text").withColumn("split", shards.three_way_split(F.col("chunk_id"), 0.1, 0.05))
    path = scratch_path(spark, "shards")
    shards.write_shards(rows, path, shard_bytes=SHARD_BYTES)
    return path


@query(f"WITH {_PLACED} SELECT split, shard, chunk_id, text FROM p")
def sharded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the files hold, read back."""
    return shards.read_shards(spark, written(spark, sf), "chunk_id string, text string")


@query(f"WITH {_PLACED} SELECT split, shard, count(*) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY split, shard")
def shard_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return shards.read_manifest(spark, written(spark, sf))
