"""Sized shards: sizes, files, rows, splits."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from chunkloom.sources import shards

SCHEMA = "chunk_id string, text string, n long"


def rows_of(spark, n=3000):
    rows = spark.range(n).selectExpr(
        "lpad(id, 6, '0') AS chunk_id", "if(id % 50 = 0, NULL, repeat(concat('é\"', id), int(1 + id % 7))) AS text", "if(id % 3 = 0, NULL, id) AS n"
    )
    return rows.withColumn("split", shards.three_way_split(F.col("chunk_id"), 0.2, 0.1))


@pytest.mark.parametrize("size", [2000, 20_000, 10_000_000])
def test_files_have_the_wanted_size_and_all_rows(spark, folder, size):
    rows = rows_of(spark)
    manifest = {(r.split, r.shard): r for r in shards.write_shards(rows, folder, shard_bytes=size).collect()}
    root = folder.removeprefix("file:")
    files = {}
    for f in glob.glob(f"{root}/split=*/shard=*/*.json"):
        split, shard = (p.split("=")[1] for p in f.split("/")[-3:-1])
        assert (split, int(shard)) not in files
        files[split, int(shard)] = f
    assert files.keys() == manifest.keys()
    last = {s: max(n for t, n in files if t == s) for s, _ in files}
    for (split, shard), f in files.items():
        lines = open(f, encoding="utf-8").read().splitlines()
        longest = max(len(x.encode()) + 1 for x in lines)
        assert (os.path.getsize(f), len(lines)) == (manifest[split, shard].bytes, manifest[split, shard].rows)
        assert os.path.getsize(f) < size + longest
        assert shard == last[split] or abs(os.path.getsize(f) - size) <= longest
        assert [json.loads(x)["chunk_id"] for x in lines] == sorted(json.loads(x)["chunk_id"] for x in lines)
        assert set(json.loads(lines[0])) == {"chunk_id", "text", "n"}
    back = shards.read_shards(spark, folder, SCHEMA).drop("shard")
    assert sorted(map(tuple, back.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_parquet_and_writing_again(spark, folder):
    rows = rows_of(spark, 500)
    for size in (1000, 5000):
        shards.write_shards(rows, folder, shard_bytes=size, form="parquet")
    back = shards.read_shards(spark, folder, SCHEMA, "parquet")
    assert back.count() == 500 and back.select("split", "shard").distinct().count() == shards.read_manifest(spark, folder).count()


def test_splits(spark):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    share = {r.s: r["count"] / 20000 for r in rows.groupBy(shards.three_way_split(F.col("k"), 0.2, 0.1).alias("s")).count().collect()}
    assert share == pytest.approx({"train": 0.7, "validation": 0.2, "test": 0.1}, abs=0.01)
    for bad in ((0.9, 0.2), (-0.1, 0)):
        with pytest.raises(ValueError):
            shards.three_way_split(F.col("k"), *bad)


def test_nothing_and_names_in_the_way(spark, folder):
    empty = rows_of(spark).limit(0)
    assert shards.write_shards(empty, folder).collect() == []
    with pytest.raises(ValueError):
        shards.write_shards(empty.withColumn("shard", F.lit(1)), folder)
    with pytest.raises(ValueError):
        shards.write_shards(empty.drop("split"), folder)
