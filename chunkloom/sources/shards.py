"""Data sets as shards of a given size, JSON lines or Parquet, in up to three splits.

A row's place is the sum of the encoded sizes of the rows before it in its split; the sums run over ranges, so a
split may be of any size.  Every ``shard_bytes`` of these a new shard begins: a shard is off the wanted size by at most
its last row, the last one of a split is the rest.  Rows are dealt to tasks by shard, and each shard becomes
one file in its own folder ``split=<name>/shard=<number>``; nothing is renamed and no file is listed by the driver.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.hashing import md5_mod
from chunkloom.plans.ranking import totals_in_group
from chunkloom.session import materialize

SHARD_BYTES = 256 << 20
MANIFEST = "_manifest"
JSON_OPTIONS = {"ignoreNullFields": "false"}


def three_way_split(key: Column, validation: float, test: float = 0.0) -> Column:
    """train, validation or test by the md5 of a key; shares are cut to whole per cents."""
    first, second = int(validation * 100), int(test * 100)
    if min(first, second) < 0 or first + second > 100:
        raise ValueError("shares must lie between 0 and 1 together")
    place = md5_mod(key, 100)
    return F.when(place < first, "validation").when(place < first + second, "test").otherwise("train")


def encoded_bytes(rows: DataFrame, without: tuple[str, ...] = ("split",)) -> Column:
    """Size of a row as a line of JSON, with its line end."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in without]
    return (F.octet_length(F.to_json(F.struct(*columns), JSON_OPTIONS)) + 1).cast("bigint")


def write_shards(
    rows: DataFrame, path: str, *, key: str = "chunk_id", shard_bytes: int = SHARD_BYTES, form: Literal["jsonl", "parquet"] = "jsonl"
) -> DataFrame:
    """Write ``rows(split, key, ...)`` ordered by ``key`` and return the manifest (split, shard, rows, bytes).

    Sizes are those of the JSON lines; a Parquet shard holds that much before it is encoded and compressed.  The
    manifest is written last, as JSON lines in ``_manifest``: without it the shards are not complete.  Columns
    ``shard`` and ``bytes`` must not be there, splits must not be null, and rows of equal keys may stand in any order.
    """
    if shard_bytes < 1:
        raise ValueError("a shard holds at least one byte")
    taken = {"shard", "bytes"} & set(rows.columns)
    if taken or "split" not in rows.columns:
        raise ValueError(f"columns in the way: {sorted(taken)}" if taken else "no column split")
    sized = rows.withColumn("bytes", encoded_bytes(rows))
    placed = totals_in_group(sized, ["split"], [key], {"_before": "bytes"})
    dealt = materialize(placed.withColumn("shard", F.floor(F.col("_before") / shard_bytes)), "shards")
    ordered = dealt.repartition("split", "shard").sortWithinPartitions("split", "shard", "_before").drop("_before", "bytes")
    writer = ordered.write.mode("overwrite").partitionBy("split", "shard")
    if form == "jsonl":
        writer.options(**JSON_OPTIONS).json(path)
    else:
        writer.parquet(path)
    manifest = dealt.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    manifest.write.mode("overwrite").json(f"{path}/{MANIFEST}")
    return read_manifest(rows.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, shard bigint, rows bigint, bytes bigint").json(f"{path}/{MANIFEST}")


def read_shards(spark: SparkSession, path: str, schema: str, form: Literal["jsonl", "parquet"] = "jsonl") -> DataFrame:
    """Rows of all shards with their split and shard; ``schema`` names the other columns."""
    reader = spark.read.schema(f"{schema}, split string, shard bigint")
    return reader.json(path) if form == "jsonl" else reader.parquet(path)
